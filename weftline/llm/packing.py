"""Operator 10: length buckets with least padding, and batches within a token budget.

Spark counts the global histogram of lengths; dynamic programming over it
chooses the bucket boundaries for which the padding of all documents up to
their bucket's boundary is least. Inside each bucket documents are numbered
through and cut into batches of as many documents as the token budget holds
at the bucket's length (one at least, so nothing is left out or split).

Length: words ([^\\x20\\x09-\\x0D]+) of the whole text; null and empty texts
have length 0 and take part. Each row is packed, whatever its id, so repeated
rows stay. An empty table gives an empty result. Columns besides ``doc_id``
and ``text`` are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import exchange as X

BUCKETS, TOKEN_BUDGET = 16, 16_384


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Ascending boundaries (the last is the greatest length) of at most
    ``buckets`` buckets with least total padding. The cost of a bucket obeys
    the quadrangle inequality, so the best split points ascend and each layer
    is solved by halving, all midpoints of a level at once."""
    size = np.asarray(lengths, dtype=np.int64)
    n = len(size)
    if not n:
        return []
    upto = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    tokens = np.concatenate([[0], np.cumsum(size * np.asarray(counts, dtype=np.int64))])

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Padding of the lengths i+1 .. j (counted from 1) in one bucket."""
        return size[j - 1] * (upto[j] - upto[i]) - (tokens[j] - tokens[i])

    best = np.concatenate([[0], cost(np.zeros(n, np.int64), np.arange(1, n + 1))])
    splits = []
    for k in range(2, min(buckets, n) + 1):
        now, split = best.copy(), np.zeros(n + 1, dtype=np.int64)
        lo, hi, a, b = (np.array([x]) for x in (k, n, k - 1, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            last = np.minimum(b, mid - 1)
            width = last - a + 1
            first = np.cumsum(width) - width
            i = np.arange(int(width.sum())) - np.repeat(first - a, width)
            value = best[i] + cost(i, np.repeat(mid, width))
            low = np.minimum.reduceat(value, first)
            at = np.flatnonzero(value == np.repeat(low, width))
            owner = np.searchsorted(first, at, side="right") - 1
            chosen = np.empty(len(mid), dtype=np.int64)
            chosen[owner[::-1]] = i[at[::-1]]
            now[mid], split[mid] = low, chosen
            left, right = lo < mid, mid < hi
            lo, hi, a, b = np.concatenate([lo[left], mid[right] + 1]), np.concatenate([mid[left] - 1, hi[right]]), np.concatenate([a[left], chosen[right]]), np.concatenate([chosen[left], b[right]])
        if now[n] >= best[n]:
            break
        best = now
        splits.append(split)
    out, j = [int(size[n - 1])], n
    for split in reversed(splits):
        j = int(split[j])
        out.append(int(size[j - 1]))
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), bucket_tokens (its boundary), batch
    (from 0 in its bucket), slot (from 0 in its batch) and padding of every row."""
    spark = docs.sparkSession
    size = F.coalesce((word_count(F.col("text")) if length is None else length).cast("long"), F.lit(0))
    rows = X.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_tokens")))
    # k distinct lengths have k * (k - 1) / 2 tokens at least, so these are about sqrt(2 * all tokens) lines at most
    histogram = sorted((r["l"], r["n"]) for r in rows.groupBy(F.col("n_tokens").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = best_boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)
    number = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        number = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(number)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    per_batch = F.array(*[F.lit(max(1, token_budget // max(b, 1))).cast("long") for b in bounds]) if bounds else F.array(F.lit(1).cast("long"))
    # the rows come from a checkpoint, so their partitions and order are the same at every reading
    placed = rows.select("*", number.cast("int").alias("bucket"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    per_part = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select("bucket", "part", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("at"))
    numbered = placed.withColumn("local", local).join(offsets, ["bucket", "part"])
    position = F.col("before") + F.col("local") - 1
    return numbered.select(
        "doc_id", "n_tokens", "bucket", F.element_at(limits, F.col("bucket") + 1).alias("bucket_tokens"),
        F.floor(position / F.element_at(per_batch, F.col("bucket") + 1)).cast("long").alias("batch"),
        F.pmod(position, F.element_at(per_batch, F.col("bucket") + 1)).cast("long").alias("slot"),
        (F.element_at(limits, F.col("bucket") + 1) - F.col("n_tokens")).alias("padding"),
    )


def bucket_of(n_tokens: int, bounds: list[int]) -> int:
    return min(bisect_left(bounds, n_tokens), len(bounds) - 1)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
