"""BM25 over packed postings.

Documents are packed into *pages* where they are read; a page holds a bounded
number of documents, and for each of its terms one row, a *block*: the term's
documents in the page with frequency and length, and what bounds the term's
part in any score (greatest frequency, least length). A term that is in every
document so fills one row per page, never one group. Scores of a page need that
page's blocks only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as tx

#: Documents and tokens of a page at most (a longer document is a page of its own).
PAGE_DOCS, PAGE_TOKENS = 4096, 1 << 20
#: Bytes of the queries' terms in one pass; more queries take several passes.
TERM_BYTES = 8 << 20
#: Entries (posting and query) that are summed at once.
ENTRIES = 1 << 21


def blocks_type(id_type: T.DataType) -> T.StructType:
    arrays = [("ids", id_type), ("places", T.IntegerType()), ("tf", T.IntegerType()), ("lengths", T.IntegerType())]
    slim = [("page", T.LongType()), ("n", T.IntegerType()), ("max_tf", T.IntegerType()), ("min_length", T.IntegerType())]
    return T.StructType([T.StructField("term", T.StringType()), *[T.StructField(n, t) for n, t in slim], *[T.StructField(n, T.ArrayType(t)) for n, t in arrays]])


def tokenised(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id and its tokens; rows without an id take no part."""
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tx.tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))


def packed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", terms: set[str] | None = None, page_docs: int | None = None) -> DataFrame:
    """The blocks of all documents (of some terms, if they are given), and for each
    page a row without a term whose ids and lengths are those of all its documents.

    No token is shuffled. A page's number comes from its task and its place there,
    so ``docs`` must come in the same order when a lost task is run again, as the
    rows of a file scan do."""
    own = tokenised(docs, id_col, text).withColumn("_part", F.spark_partition_id())
    most = page_docs or PAGE_DOCS
    shared = None if terms is None else docs.sparkSession.sparkContext.broadcast(sorted(terms))
    id_type = own.schema["id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared is None else pa.array(shared.value, pa.string())
        number = 0
        for page in _pages(batches, most):
            part = page.column("_part")[0].as_py()
            yield _blocks(page, (part << 32) + number, wanted)
            number += 1

    return own.mapInArrow(pack, blocks_type(id_type))


def _pages(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of bounded size."""
    held, docs, tokens = [], 0, 0
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.list_value_length(batch.column("_t")), 0)).astype(np.int64)
        at = 0
        while at < len(size):
            room = np.searchsorted(np.cumsum(size[at : at + most - docs]), PAGE_TOKENS - tokens, side="right")
            stop = at + int(room) if room or held else at + 1
            if stop > at:
                held.append(batch.slice(at, stop - at))
                docs, tokens = docs + stop - at, tokens + int(size[at:stop].sum())
            if docs >= most or tokens >= PAGE_TOKENS or stop < len(size):
                yield _one(held)
                held, docs, tokens = [], 0, 0
            at = stop
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(page: pa.RecordBatch, number: int, wanted: pa.Array | None) -> pa.RecordBatch:
    lists, ids = page.column("_t"), page.column("id")
    length = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    doc = np.repeat(np.arange(len(length)), length)
    if wanted is None:
        coded = lists.flatten().dictionary_encode()
        names, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    else:
        found = pc.index_in(lists.flatten(), wanted)
        known = np.asarray(found.is_valid())
        names, code, doc = wanted, np.asarray(found.drop_null()).astype(np.int64), doc[known]
    pair, tf = np.unique(code * len(length) + doc, return_counts=True) if len(code) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    code, doc = pair // max(1, len(length)), pair % max(1, len(length))
    first = np.flatnonzero(np.diff(code, prepend=-1))
    count = np.diff(np.append(first, len(code)))
    # the row without a term comes last
    edges = pa.array(np.concatenate([first, [len(code), len(code) + len(length)]]), pa.int32())
    places = np.concatenate([doc, np.arange(len(length))])
    lists_of = lambda values, kind: pa.ListArray.from_arrays(edges, values if isinstance(values, pa.Array) else pa.array(values, kind))
    least = np.minimum.reduceat(length[doc], first) if len(first) else np.zeros(0, np.int64)
    great = np.maximum.reduceat(tf, first) if len(first) else np.zeros(0, np.int64)
    terms = names.take(pa.array([*code[first].tolist(), None], pa.int64()))
    rows = len(first) + 1
    columns = [terms.cast(pa.string()), pa.array(np.full(rows, number), pa.int64()), pa.array(np.append(count, len(length)), pa.int32()), pa.array(np.append(great, 0), pa.int32()), pa.array(np.append(least, 0), pa.int32())]
    columns += [lists_of(ids.take(pa.array(places)), None), lists_of(places, pa.int32()), lists_of(np.concatenate([tf, np.zeros(len(length), np.int64)]), pa.int32()), lists_of(np.concatenate([length[doc], length]), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["term", "page", "n", "max_tf", "min_length", "ids", "places", "tf", "lengths"])


def idf(n: int, df: int) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1.0)


def saturation(tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    """A term's share of a score, without its weight."""
    tf = tf.cast("double")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean or 1.0)))


def weight_of(term: Column, weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), term)


def scored(blocks: DataFrame, weights: dict[str, float], mean: float, k1: float, b: float) -> DataFrame:
    """page, place, id and score of every document in the blocks of a short list of terms."""
    rows = blocks.select("term", "page", F.explode(F.arrays_zip("ids", "places", "tf", "lengths")).alias("p")).select("term", "page", "p.*")
    part = weight_of(F.col("term"), weights) * saturation(F.col("tf"), F.col("lengths"), mean, k1, b)
    return rows.select("page", F.col("places").alias("place"), F.col("ids").alias("id"), part.alias("part")).groupBy("page", "place").agg(F.first("id").alias("id"), F.sum("part").alias("score"))


def bounded(blocks: DataFrame, weights: dict[str, float], mean: float, k1: float, b: float) -> DataFrame:
    """page and bound: no document of the page scores more."""
    part = weight_of(F.col("term"), weights) * saturation(F.col("max_tf"), F.col("min_length"), mean, k1, b)
    return blocks.select("page", part.alias("part")).groupBy("page").agg((F.sum("part") * (1 + 1e-9)).alias("bound"))


def batch_scores(blocks: DataFrame, pairs: list[tuple], mean: float, k: int, k1: float, b: float, query_type: str) -> DataFrame:
    """query_id, id, score: k documents of every query at most from each task.
    blocks: those of the queries' terms, a page's rows in one task and together;
    pairs: (term, query_id, weight), in order."""
    shared = blocks.sparkSession.sparkContext.broadcast((pairs, mean or 1.0))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, average = shared.value
        terms = pa.array(list(dict.fromkeys(t for t, _, _ in held)), pa.string())
        names = list(dict.fromkeys(q for _, q, _ in held))
        place = {q: i for i, q in enumerate(names)}
        query, weight = np.array([place[q] for _, q, _ in held], np.int64), np.array([w for _, _, w in held])
        first = np.searchsorted(np.asarray(pc.index_in(pa.array([t for t, _, _ in held], pa.string()), terms)), np.arange(len(terms) + 1))
        best = _Best(k)
        for page in _together(batches):
            code = np.asarray(pc.index_in(page.column("term"), terms)).astype(np.int64)
            size = np.asarray(page.column("tf").value_lengths()).astype(np.int64)
            flat = lambda c: np.asarray(page.column(c).flatten()).astype(np.float64)
            tf, length = flat("tf"), flat("lengths")
            own = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
            doc, code, ids = np.asarray(page.column("places").flatten()).astype(np.int64), np.repeat(code, size), page.column("ids").flatten()
            turn = np.argsort(doc, kind="stable")
            doc, code, own, ids = doc[turn], code[turn], own[turn], ids.take(pa.array(turn))
            entries = first[code + 1] - first[code]
            upto = np.cumsum(entries)
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            at = 0
            while at < len(starts):  # some documents with all their entries
                before = upto[starts[at] - 1] if starts[at] else 0
                stop = max(at + 1, int(np.searchsorted(upto[np.append(starts[at + 1 :], len(doc)) - 1], before + ENTRIES, side="right")) + at)
                lo, hi = starts[at], starts[stop] if stop < len(starts) else len(doc)
                count = entries[lo:hi]
                entry = np.arange(int(count.sum())) + np.repeat(first[code[lo:hi]] - (np.cumsum(count) - count), count)
                which = np.repeat(np.cumsum(np.diff(doc[lo:hi], prepend=doc[lo]) != 0), count)
                both, inverse = np.unique(which * len(names) + query[entry], return_inverse=True)
                total = np.bincount(inverse, weights=np.repeat(own[lo:hi], count) * weight[entry], minlength=len(both))
                best.add(both % len(names), total, ids.take(pa.array(starts[at:stop][both // len(names)])))
                at = stop
        for q, total, ids in best.end():
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()]), ids, pa.array(total)], ["query_id", "id", "score"])

    return blocks.mapInArrow(score, f"query_id {query_type}, id {kind}, score double")


class _Best:
    """The k best documents of every query among all that were added, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.held, self.rows, self.kept = k, [], 0, 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.held.append((query, score, ids))
        self.rows += len(query)
        if self.rows > max(1 << 17, 2 * self.kept):
            self._cut()

    def _cut(self) -> None:
        query, score = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        ids = pa.concat_arrays([x[2] for x in self.held])
        order = np.empty(len(ids), dtype=np.int64)
        order[np.asarray(pc.array_sort_indices(ids))] = np.arange(len(ids))
        turn = np.lexsort((order, -np.round(score, 6), query))
        begin = np.searchsorted(query[turn], query[turn])
        turn = turn[np.arange(len(turn)) - begin < self.k]
        self.held, self.rows, self.kept = [(query[turn], score[turn], ids.take(pa.array(turn)))], len(turn), len(turn)

    def end(self):
        if self.rows:
            self._cut()
        return self.held


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of each page, one page after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        page = np.asarray(batch.column("page"))
        edges = [0, *(np.flatnonzero(np.diff(page)) + 1).tolist(), len(page)]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if held and z > a and held[0].column("page")[0].as_py() != page[a]:
                yield _one(held)
                held = []
            if z > a:
                held.append(batch.slice(a, z - a))
    if held:
        yield _one(held)


def page_by_page(blocks: DataFrame) -> DataFrame:
    """A page's rows in one task and together, as ``batch_scores`` needs them."""
    return blocks.repartition("page").sortWithinPartitions("page")


def ranked_batch(found: DataFrame, k: int, id_col: str) -> DataFrame:
    """query_id, id, rank, score: the k best of all tasks' lists."""
    # sums differ in their last bits with the order of the terms: equal to six decimals is equal
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "rank", "score")


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times of the queries (query_id, text)."""
    tokens = queries.filter("query_id is not null").select("query_id", F.explode(tx.tokens(F.coalesce(F.col("text"), F.lit("")))).alias("term"))
    return tokens.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def query_parts(asked: DataFrame, room: int) -> Iterator[list]:
    """The rows of ``asked_terms`` in parts of ``room`` bytes of terms on average, whole queries each."""
    size = asked.agg(F.sum(F.octet_length("term") + 24).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // room))
    for number in range(parts):
        yield asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == number).collect()
