"""Operator 1: exact top-k search by inner product.

Candidates are packed into shards, queries into blocks; every block meets
every shard in a tile of bounded size, a matrix product with a partial
selection of the k best of each query. The tiles are dealt as a grid, whose
sides are chosen so that the bytes copied (query blocks along one side, shards
along the other) are fewest. The lists of a query are merged in levels, each
merging a bounded number of tiles.

Components become floor(256 * x) with x as double; scores are exact integer
inner products (in float32 or float64 where all sums fit exactly, else in
Python integers, clipped to the range of long). Vectors that are null or hold
a null or non-finite component take no part, nor does a null id. A query meets
only candidates of its own length. Equal scores go to the smaller vec_id.
Rows that repeat id and vector count once; an id with several vectors is one
query, and each of its vectors is a candidate. Empty tables give an empty
result. Columns besides ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_ROWS, SHARD_ROWS, FAN_IN = 512, 8192, 64
#: Tiles that a cell of the grid, and so a task, has at most on average.
TILES = 64
LONG = (-(1 << 63), (1 << 63) - 1)


def _usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and e, the components as doubles, of the vectors that take part
    (floored when packed: a floor in SQL would turn to long and overflow)."""
    double = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = double.filter(F.col("vec_id").isNotNull() & _usable(F.col("e")))
    return usable.select("vec_id", "e")


def _packed(rows: DataFrame, limit: int, name: str) -> DataFrame:
    """Rows of one partition as blocks of up to ``limit`` vectors of one length:
    dim, ids, kind (the smallest type that holds all components) and data
    (already floored)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([x for x, _ in held[dim]])
            data = np.concatenate([y for _, y in held[dim]])
            held[dim] = []
            most = np.abs(data).max(initial=0.0)
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([kind]), pa.array([data.astype(kind).tobytes()], pa.binary())], [f"{name}_{x}" for x in ("dim", "ids", "kind", "data")])

        for batch in batches:
            vec, ids = batch.column("e"), batch.column("vec_id").to_numpy(zero_copy_only=False)
            size = np.asarray(vec.value_lengths()).astype(np.int64)
            flat = np.floor(256.0 * np.asarray(vec.flatten(), dtype=np.float64))
            start = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                rows_ = np.flatnonzero(size == dim)
                data = flat[(start[rows_][:, None] + np.arange(dim)[None, :])]
                for at in range(0, len(rows_), limit):
                    held.setdefault(dim, []).append((ids[rows_[at : at + limit]], data[at : at + limit]))
                    if sum(len(x) for x, _ in held[dim]) >= limit:
                        yield block(dim)
        for dim in list(held):
            if held[dim]:
                yield block(dim)

    return rows.mapInArrow(pack, f"{name}_dim int, {name}_ids binary, {name}_kind string, {name}_data binary")


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as float64 where they fit, else as clipped int64."""
    dim = q.shape[1]
    top = (np.abs(q).max(initial=0.0)) * (np.abs(c).max(initial=0.0)) * max(dim, 1)
    if top < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    if top < 1 << 53:
        return q @ c.T
    if top < 1 << 63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in q], dtype=object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in c], dtype=object).reshape(c.shape).T
    return np.clip(exact, *LONG).astype(np.int64)


def tile_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best in one tile."""
    both = np.arange(len(c_ids))
    if len(np.unique(c_ids)) < len(c_ids):  # rows that repeat id and vector count once; ids are compared as whole numbers
        whole = np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(len(c_ids), -1) for x in (c_ids.astype(np.int64), c + 0.0)], axis=1)
        both = np.unique(whole, axis=0, return_index=True)[1]
    order = both[np.argsort(c_ids[both], kind="stable")]
    c_ids, c = c_ids[order], c[order]
    scores = _products(q, c)
    several = len(np.unique(c_ids)) < len(c_ids)
    out_q, out_c, out_s = [], [], []
    for i in range(len(q_ids)):
        s, ids = scores[i], c_ids
        first, last = np.searchsorted(c_ids, q_ids[i], "left"), np.searchsorted(c_ids, q_ids[i], "right")
        if first < last:  # the query's own rows, however many, take no place
            s, ids = np.delete(s, slice(first, last)), np.delete(ids, slice(first, last))
        take = min(k, len(ids))
        if several:  # an id's vectors with one score are one candidate
            pick = np.lexsort((ids, -s))
            new = np.ones(len(pick), dtype=bool)
            new[1:] = (s[pick][1:] != s[pick][:-1]) | (ids[pick][1:] != ids[pick][:-1])
            pick = pick[new]
        elif take < len(ids):
            edge = np.partition(s, len(ids) - take)[len(ids) - take]
            above, equal = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
            pick = np.concatenate([above, equal[: take - len(above)]])
        else:
            pick = np.arange(len(ids))
        pick = pick[np.lexsort((ids[pick], -s[pick]))][:k]
        out_q.append(np.full(len(pick), q_ids[i]))
        out_c.append(ids[pick])
        out_s.append(s[pick].astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _best(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best distinct (score, vec_id) for each value of the keys."""
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("vec_id"))
    return lists.withColumn("rank", F.dense_rank().over(window)).filter(F.col("rank") <= k).dropDuplicates([*keys, "rank"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each
    query other than those with its own id. Both tables: vec_id, embedding."""
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = quantised(queries).distinct()
    n_asked, n_rows = asked.count(), candidates.count()
    n_blocks, n_shards = max(1, -(-n_asked // QUERY_ROWS)), max(1, -(-n_rows // SHARD_ROWS))
    # a grid of some cells for each partition: queries are copied to each column, candidates to each row
    cells = min(max(4 * parts, n_blocks * n_shards // TILES), n_blocks * n_shards)
    columns = min(n_shards, cells, max(1, round(math.sqrt(cells * n_rows / max(n_asked, 1)))))
    rows = min(n_blocks, max(1, -(-cells // columns)))
    blocks = _packed(asked.repartition(n_blocks, F.xxhash64("vec_id", "e")), QUERY_ROWS, "q")
    blocks = blocks.withColumn("row", F.pmod(F.xxhash64("q_ids"), F.lit(rows)).cast("int"))
    blocks = blocks.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    shards = _packed(quantised(candidates), SHARD_ROWS, "c").withColumn("tile", F.xxhash64("c_ids"))
    shards = shards.withColumn("column", F.pmod("tile", F.lit(columns)).cast("int"))
    shards = shards.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    tiles = shards.join(blocks, ["row", "column"]).filter("q_dim = c_dim")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("q_dim")[r].as_py()
                q_ids, c_ids = (np.frombuffer(batch.column(x)[r].as_buffer(), np.int64) for x in ("q_ids", "c_ids"))
                q, c = (np.frombuffer(batch.column(f"{x}_data")[r].as_buffer(), batch.column(f"{x}_kind")[r].as_py()).astype(np.float64).reshape(len(ids), dim) for x, ids in (("q", q_ids), ("c", c_ids)))
                a, b, s = tile_top(q_ids, q, c_ids, c, k)
                tile = np.full(len(a), batch.column("tile")[r].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64()), pa.array(tile, pa.int64())], ["query_id", "vec_id", "score", "tile"])

    lists = tiles.select("q_dim", "q_ids", "q_kind", "q_data", "c_ids", "c_kind", "c_data", "tile").mapInArrow(search, "query_id long, vec_id long, score long, tile long")
    groups = n_shards
    while groups > FAN_IN:  # a level of the tree: up to FAN_IN lists on average become one
        groups = -(-groups // FAN_IN)
        lists = _best(lists.withColumn("tile", F.pmod("tile", F.lit(groups))), ["query_id", "tile"], k).drop("rank")
    return _best(lists, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)


OP1_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
