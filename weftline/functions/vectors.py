"""Vectors, as columns, and the plug-in embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a tiny addition to each norm keeps zero vectors at 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return _dot(a, b) / ((F.sqrt(_dot(a, a)) + 1e-10) * (F.sqrt(_dot(b, b)) + 1e-10))


def clamped_similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in model: words hashed into ``dim`` signed places, unit length.
    It compares words, not meanings."""

    def encode(texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), dim), dtype=np.float32)
        places: dict[str, int] = {}  # of the words of these texts: twice the place, and 1 for a plus
        for i, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower())
            for word in set(words).difference(places):
                h = zlib.crc32(word.encode())
                places[word] = h % dim * 2 + (h >> 16 & 1)
            counts = np.bincount([places[w] for w in words], minlength=2 * dim) if words else np.zeros(2 * dim)
            out[i] = counts[1::2] - counts[::2]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder):
    """An embedding column function. ``load`` runs once in each worker."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series(list(encode(texts.fillna("").tolist())), index=texts.index)

    return embed
