"""Outer models as column functions: an encoder and a scorer of pairs.

``load`` runs once in each worker and gives the model; Spark hands it batches,
so one model serves all rows of its worker's tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encode = Callable[[list[str]], np.ndarray]
Score = Callable[[list[str], list[str]], np.ndarray]


def _texts(column: np.ndarray) -> list[str]:
    return ["" if x is None or x != x else str(x) for x in column.reshape(-1)]


def encoder(load: Callable[[], Encode], batch: int = 256) -> Callable[[Column], Column]:
    """The vector of a text; null is the empty text. A vector that isn't finite raises."""

    def make():
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.asarray(model(_texts(texts)), dtype=np.float32)
            if not np.isfinite(out).all():
                raise ValueError("the encoder gave a vector that isn't finite")
            return out

        return predict

    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)


def pair_scorer(load: Callable[[], Score], batch: int = 64) -> Callable[[Column, Column], Column]:
    """The score of a question and a text, as a logit; greater is better."""

    def make():
        model = load()

        def predict(questions: np.ndarray, texts: np.ndarray) -> np.ndarray:
            return np.asarray(model(_texts(questions), _texts(texts)), dtype=np.float64)

        return predict

    scored = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch)
    return lambda question, text: scored(F.coalesce(question, F.lit("")), F.coalesce(text, F.lit("")))
