"""Profiles that can be merged: one small row of sketches for each chunk and column.

A full distinct of every text column of a large table shuffles its values; a
sketch of a chunk is some kilobytes, made where the rows are, kept in a table
and merged with those of other chunks, so only new chunks are ever read.
Distinct values come from HyperLogLog sketches (``LG_K``: 2**12 counters, about
1.6 % standard error), quantiles of numbers from KLL sketches (``KLL_K``: about
0.8 % of the rank). The exact way stays in ``profile.cardinality`` and
``usage.p95_latency``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.model import Strategy
from weftline.operators import profile

LG_K, KLL_K = 12, 200
SKETCH = "chunk string, column string, rows long, non_null long, hll binary, kll binary"


def sketched(df: DataFrame, chunk: Column | str, columns: list[str] | None = None) -> DataFrame:
    """chunk, column, rows, non_null, hll and kll (of numbers, else null) of the rows
    of each chunk. One aggregation with partial sketches, whatever the columns."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = columns or [c for c, k in kinds.items() if not isinstance(k, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    name = F.col(chunk) if isinstance(chunk, str) else chunk
    parts = []
    for i, c in enumerate(names):
        number = isinstance(kinds[c], T.NumericType)
        parts += [F.count(c).alias(f"n{i}"), F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(f"h{i}")]
        parts.append((F.kll_sketch_agg_double(F.col(c).cast("double"), KLL_K) if number else F.lit(None).cast("binary")).alias(f"k{i}"))
    wide = df.groupBy(name.cast("string").alias("chunk")).agg(F.count(F.lit(1)).alias("rows"), *parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null"), F.col(f"h{i}").alias("hll"), F.col(f"k{i}").alias("kll")) for i, c in enumerate(names)])
    return wide.select("chunk", "rows", F.explode(rows).alias("r")).select("chunk", "r.column", "rows", "r.non_null", "r.hll", "r.kll")


def merged(sketches: DataFrame) -> DataFrame:
    """column, rows, non_null, distinct (estimated, never over non_null), ratio and kll of all chunks together."""
    both = sketches.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.hll_union_agg("hll").alias("hll"), F.when(F.count("kll") > 0, F.kll_merge_agg_double("kll")).alias("kll"))
    distinct = F.least(F.hll_sketch_estimate("hll"), F.col("non_null"))
    ratio = F.when(F.col("non_null") > 0, distinct / F.col("non_null")).otherwise(0.0)
    return both.select("column", "rows", "non_null", distinct.alias("distinct"), ratio.alias("ratio"), "kll")


def quantiles(profiled: DataFrame, at: list[float]) -> DataFrame:
    """column and quantiles (one for each rank in ``at``) of the numeric columns of ``merged``."""
    some = profiled.filter(F.col("kll").isNotNull() & (F.col("non_null") > 0))
    return some.select("column", F.when(F.col("non_null") > 0, F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit(float(q)) for q in at]))).alias("quantiles"))


def keep(spark: SparkSession, folder: str, df: DataFrame, chunk: str, columns: list[str] | None = None) -> int:
    """Add the sketches of chunks that the table in ``folder`` hasn't yet; returns
    how many it has then. The rows of known chunks aren't sketched again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    new = df.filter(F.col(chunk).isNotNull())
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        known = kept(spark, folder).select(F.col("chunk").alias("_chunk")).distinct()
        new = new.join(F.broadcast(known), F.col(chunk).cast("string") == F.col("_chunk"), "left_anti")  # one name for each chunk
    sketched(new, chunk, columns).coalesce(1).write.mode("append").parquet(folder)
    return kept(spark, folder).select("chunk").distinct().count()


def kept(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SKETCH).parquet(folder)


def classify(df: DataFrame, sketches: DataFrame, threshold: float = 0.3) -> Strategy:
    """``profile.classify`` with the shares of distinct values taken from sketches.
    A share closer to the threshold than three standard errors is counted exactly."""
    ratios = {r["column"]: r["ratio"] for r in merged(sketches).select("column", "ratio").collect()}
    error = 3 * 1.04 / 2 ** (LG_K / 2)

    def shares(texts: DataFrame, columns: list[str]) -> dict[str, float]:
        near = [c for c in columns if c not in ratios or abs(ratios[c] - threshold) <= error * ratios[c]]
        exact = {r["column"]: r["ratio"] for r in profile.cardinality(texts, near).collect()} if near else {}
        return {c: exact.get(c, ratios.get(c, 0.0)) for c in columns}

    return profile.classify(df, threshold, shares=shares)

