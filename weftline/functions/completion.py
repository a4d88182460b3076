"""Answers from a language model for many prompts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

RETRIES, FIRST_WAIT_S = 3, 1.5


def with_retries(complete: Callable[[str], str], prompt: str, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> str:
    """The answer; after a failure it waits 1.5, 3, ... seconds, then raises the last error."""
    for turn in range(retries):
        try:
            return complete(prompt)
        except (OSError, RuntimeError):
            if turn == retries - 1:
                raise
            wait(FIRST_WAIT_S * 2**turn)
    raise ValueError("at least one try is needed")


def complete_batch(prompts: DataFrame, load: Callable[[], Callable[[str], str]], prompt: str = "prompt") -> DataFrame:
    """prompts with ``answer`` (null if every try failed) and ``error``. load
    makes the client, once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = load()
        for rows in batches:
            answers, errors = [], []
            for text in rows[prompt]:
                try:
                    answers.append(with_retries(client, text))
                    errors.append(None)
                except (OSError, RuntimeError) as error:
                    answers.append(None)
                    errors.append(str(error)[:500])
            yield rows.assign(answer=answers, error=errors)

    schema = T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
    return prompts.mapInPandas(run, schema)
