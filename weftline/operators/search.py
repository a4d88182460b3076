"""Vector search, keyword search, fusion, lookup and reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.operators import keywords as kw


def top_k(vectors: DataFrame, query: list[float], k: int = 8, threshold: float | None = None, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, similarity (0 at least), distance of the k rows nearest to one query
    vector; those under the threshold go after the cut. One scan with a bounded
    heap per task, no shuffle of the rows."""
    probe = F.array(*[F.lit(float(x)) for x in query])
    sim = vx.cosine(F.col(embedding), probe)
    out = vectors.filter(F.col(embedding).isNotNull()).select(F.col(id_col), sim.alias("_s"))
    out = out.orderBy(F.desc("_s"), F.asc(id_col)).limit(k)
    out = out.select(id_col, vx.clamped_similarity(1 - F.col("_s")).alias("similarity"), (1 - F.col("_s")).alias("distance"))
    return out if threshold is None else out.filter(F.col("similarity") >= threshold)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", embedding: str = "embedding", query_col: str | None = None, threshold: float | None = None) -> DataFrame:
    """query_id, id, rank, similarity: the k nearest rows of every row of queries,
    other than the row's own if both tables have the same ids (``query_col`` not
    given). Rows under the threshold go after the cut. Vectors that are null,
    hold nulls or differ in length from the query's take no part.

    Queries are packed into blocks and rows into shards on the executors; a grid
    of cells brings each block and each shard together, queries copied along one
    side and rows along the other, whichever way copies least. A tile keeps k rows
    of each query, and a window merges the tiles. Nothing passes the driver."""
    spark = vectors.sparkSession
    key = query_col or id_col
    asked = _vectors(queries, key, embedding, queries.schema[key].dataType).repartition(F.col("id"))
    stored = _vectors(vectors, id_col, embedding, vectors.schema[id_col].dataType)
    n_asked, n_stored = asked.count(), stored.count()
    blocks, shards = max(1, -(-n_asked // QUERY_BLOCK)), max(1, -(-n_stored // SHARD_BLOCK))
    cells = min(blocks * shards, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * shards // TILES))
    columns = min(shards, cells, max(1, round((cells * n_stored / max(n_asked, 1)) ** 0.5)))
    rows = min(blocks, -(-cells // columns))
    asked = _packed(asked, "q", QUERY_BLOCK).withColumn("row", F.pmod(F.xxhash64("q_data"), F.lit(rows)).cast("int"))
    asked = asked.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    stored = _packed(stored, "v", SHARD_BLOCK).withColumn("column", F.pmod(F.xxhash64("v_data"), F.lit(columns)).cast("int"))
    stored = stored.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    tiles = stored.join(asked, ["row", "column"]).filter("q_dim = v_dim").drop("row", "column", "q_dim")
    of = lambda df, c: df.schema[c].dataType.simpleString()
    found = tiles.mapInArrow(_tile_search(k, query_col is None, id_col), f"query_id {of(queries, key)}, {id_col} {of(vectors, id_col)}, similarity double")
    # equal vectors may differ in the last bits from tile to tile: equal to twelve decimals is equal, as in a tile
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), F.asc(id_col))
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", id_col, "rank", "similarity")
    return out if threshold is None else out.filter(F.col("similarity") >= threshold)


#: Rows of a block of queries and of a shard; tiles of a cell of the grid on average at most.
QUERY_BLOCK, SHARD_BLOCK, TILES = 256, 4096, 64


def _vectors(rows: DataFrame, id_col: str, embedding: str, kind) -> DataFrame:
    whole = F.col(embedding).isNotNull() & F.coalesce(~F.exists(embedding, lambda x: x.isNull()), F.lit(False))
    return rows.filter(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast(kind).alias("id"), F.col(embedding).cast("array<double>").alias("e"))


def _packed(rows: DataFrame, name: str, most: int) -> DataFrame:
    """Blocks of up to ``most`` unit vectors of one length: dim, ids (array) and data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, e = batch.column("id"), batch.column("e")
            size = np.asarray(e.value_lengths()).astype(np.int64)
            flat, first = np.asarray(e.flatten(), dtype=np.float64), np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                for at in range(0, len(own), most):
                    part = own[at : at + most]
                    data = _unit(flat[first[part][:, None] + np.arange(dim)[None, :]])
                    held = ids.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), held), pa.array([data.tobytes()], pa.binary())], [f"{name}_dim", f"{name}_ids", f"{name}_data"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"{name}_dim int, {name}_ids array<{kind}>, {name}_data binary")


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-10)


def _tile_search(k: int, others_only: bool, id_col: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("v_dim")[r].as_py()
                ids, own = batch.column("q_ids")[r].values, batch.column("v_ids")[r].values
                q, v = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float64).reshape(-1, dim) for c in ("q_data", "v_data"))
                turn = np.argsort(np.asarray(own.to_pylist()), kind="stable")  # ties go to the smaller id
                own, v = own.take(pa.array(turn)), v[turn]
                sims = np.maximum(q @ v.T, 0.0)
                if others_only:
                    sims[np.asarray(ids.to_pylist())[:, None] == np.asarray(own.to_pylist())[None, :]] = -1
                rounded = np.round(sims, 12)
                take = min(k, len(own))
                edge = -np.partition(-rounded, take - 1, axis=1)[:, take - 1] if take else np.zeros(len(q))
                at, place = [], []
                for i in range(len(q)):
                    some = np.flatnonzero(rounded[i] >= edge[i])
                    some = some[np.argsort(-rounded[i, some], kind="stable")][:take]
                    some = some[rounded[i, some] >= 0]
                    at.append(np.full(len(some), i))
                    place.append(some)
                at, place = np.concatenate(at), np.concatenate(place)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), own.take(pa.array(place)), pa.array(sims[at, place])], ["query_id", id_col, "similarity"])

    return search


def bm25_statistics(counted: DataFrame, terms: list[str]) -> dict:
    """Documents, mean length and document frequency of the terms of ``term_counts``."""
    row = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col("tf")[i] > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    return {"n": row["n"], "mean": row["mean"] or 0.0, "df": {t: row[f"d{i}"] or 0 for i, t in enumerate(terms)}}


def term_counts(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, length (tokens) and tf (how often each of the terms stands in the text), of every document."""
    own = docs.select(id_col, tx.tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    # one look at each token: those that are terms, as their places among the terms
    places = F.filter(F.transform("_t", lambda x: F.array_position(F.lit(terms), x)), lambda p: p > 0)
    slim = own.select(id_col, F.size("_t").alias("length"), places.alias("_p"))
    return slim.select(id_col, "length", F.array(*[F.size(F.filter("_p", _equals_place(i + 1))) for i in range(len(terms))]).alias("tf"))


def _equals_place(place: int):
    return lambda x: x == F.lit(place)


def bm25(docs: DataFrame, query_tokens: list[str], k: int | None = 10, id_col: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """id, score of the documents with a query token, best first. A token that
    stands twice in the query counts twice. The corpus is tokenised once: the
    counts of the query's terms are written down, statistics and scores come
    from them."""
    terms = list(dict.fromkeys(query_tokens))
    spark = docs.sparkSession
    if not terms:
        return spark.createDataFrame([], T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())]))
    counted = written(term_counts(docs, terms, id_col, text))
    stats = bm25_statistics(counted, terms)
    length = F.col("length") / F.lit(stats["mean"] or 1.0)
    score = F.lit(0.0)
    for term in query_tokens:
        df = stats["df"][term]
        idf = float(np.log((stats["n"] - df + 0.5) / (df + 0.5) + 1.0))
        tf = F.col("tf")[terms.index(term)].cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))
    hits = counted.filter(F.exists("tf", lambda n: n > 0)).select(id_col, score.alias("score"))
    return hits if k is None else hits.orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, shared by driver and executors:
    that in spark.checkpoint.dir; on one machine, where none is named, one beside the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "_checkpoints")
    return sc.getCheckpointDir()


def written(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder once and read from there."""
    checkpoint_folder(rows.sparkSession)
    return rows.checkpoint()


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, id, rank, score for each row of queries (query_id, text), without a
    stored index (``sources.text_index`` holds one).

    Queries are taken in parts whose terms have ``keywords.TERM_BYTES`` at most. For
    a part the corpus is tokenised once and the packed postings of its terms are
    written down; statistics come from them, and scores are summed page by page
    where the postings lie, each task keeping k documents of every query. Rows
    without an id take no part."""
    asked = written(kw.asked_terms(queries))
    kind, parts = asked.schema["query_id"].dataType.simpleString(), []
    for rows in kw.query_parts(asked, kw.TERM_BYTES):
        blocks = written(kw.packed(docs, id_col, text, {r["term"] for r in rows}))
        tokens = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
        counted = blocks.groupBy("term").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("term").isNull(), tokens)).alias("tokens")).collect()
        n, total = next(((r["n"], r["tokens"]) for r in counted if r["term"] is None), (0, 0))
        df = {r["term"]: r["n"] for r in counted if r["term"] is not None}
        pairs = sorted((r["term"], r["query_id"], r["times"] * kw.idf(n, df[r["term"]])) for r in rows if r["term"] in df)
        parts.append(kw.batch_scores(blocks.filter("term is not null"), pairs, total / max(n, 1), k, k1, b, kind))
    return kw.ranked_batch(reduce(DataFrame.unionByName, parts), k, id_col)


def fuse(ranked: list[DataFrame], id_col: str = "doc_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists (id, rank from 1, similarity): id,
    rrf_score, similarity (the greatest), lists (how many hold the id)."""
    both = ranked[0].select(id_col, "rank", "similarity")
    for more in ranked[1:]:
        both = both.unionByName(more.select(id_col, "rank", "similarity"))
    return both.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("lists"))


def ranked(rows: DataFrame, score: str, id_col: str = "doc_id") -> DataFrame:
    """rank from 1 by descending score of a short list (a top-k result)."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(id_col))))


#: Ids of a short list that are handed to the source as a filter.
PUSHED = 1000
_PLAIN = (T.IntegralType, T.StringType, T.DateType, T.FractionalType, T.TimestampType, T.TimestampNTZType)


def hydrate(hits: DataFrame, rows: DataFrame, hit_id: str, row_id: str, prefix: str = "") -> DataFrame:
    """Hits with their rows, matched on the id as text; hits without a row stay.

    The ids of up to ``PUSHED`` hits go to the source as values of its own key's
    type, so a scan of files skips what lacks them and a database looks them up."""
    kind = rows.schema[row_id].dataType
    hits = written(hits)
    some = hits.select(F.col(hit_id).cast("string").alias("i")).filter("i is not null").distinct().limit(PUSHED + 1)
    if isinstance(kind, _PLAIN):
        ids = some.select(F.col("i").try_cast(kind).alias("i")).collect()
        if len(ids) <= PUSHED:
            rows = rows.filter(F.col(row_id).isin(sorted({r["i"] for r in ids if r["i"] is not None})))
    renamed = rows.select(F.col(row_id).cast("string").alias("_key"), *[F.col(c).alias(prefix + c) for c in rows.columns])
    return hits.withColumn("_id", F.col(hit_id).cast("string")).join(renamed, F.col("_id") == F.col("_key"), "left").drop("_id", "_key")


def rerank(rows: DataFrame, scorer: Column | None, n: int = 5, order: str = "rank") -> DataFrame:
    """The n rows of a short list with the greatest score, similarity := sigmoid
    of it; without a scorer the first n as they are."""
    if scorer is None:
        return rows.orderBy(order).limit(n)
    scored = rows.withColumn("rerank_score", scorer)
    return scored.orderBy(F.desc("rerank_score"), F.asc(order)).limit(n).withColumn("similarity", vx.sigmoid(F.col("rerank_score")))


def overlap_scorer(query_tokens: list[str], text: str):
    """A stand-in for a cross-encoder: share of the query's tokens in the text, as a logit-like score."""
    want = F.array(*[F.lit(t) for t in dict.fromkeys(query_tokens)])
    return 4.0 * F.size(F.array_intersect(want, tx.tokens(F.coalesce(F.col(text), F.lit(""))))) / F.size(want) - 2.0
