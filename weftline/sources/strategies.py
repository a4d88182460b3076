"""Saved column strategies: an append-only history of JSON lines in a folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from weftline.model import Strategy


class NoStrategy(LookupError):
    """Nothing was saved for a source."""


def save(spark: SparkSession, folder: str, strategy: Strategy, source: str, at: float) -> None:
    spark.createDataFrame([(source, at, strategy.to_json())], "source string, saved_at double, strategy string").coalesce(1).write.mode("append").json(folder)


def newest(spark: SparkSession, folder: str, source: str | None = None) -> Strategy | None:
    """The strategy saved last (for a source, if given), or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    saved = spark.read.schema("source string, saved_at double, strategy string").json(folder)
    own = saved if source is None else saved.filter(saved["source"] == source)
    row = own.orderBy(own["saved_at"].desc()).select("strategy").first()
    return Strategy.from_json(row["strategy"]) if row else None


def load(spark: SparkSession, folder: str, source: str | None = None) -> Strategy:
    """``newest``; raises NoStrategy if there is none."""
    found = newest(spark, folder, source)
    if found is None:
        raise NoStrategy(f"no strategy of {source or 'any source'} in {folder}: run forward first")
    return found
