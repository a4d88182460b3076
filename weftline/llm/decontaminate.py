"""Operator 2: benchmark decontamination.

The test items, cut into pieces of a few dozen words, form a BM25 inverted
index. Every passage of every training text (stretches of ``PASSAGE`` words,
each half overlapping the next) is a query, and all pieces are retrieved whose
score reaches a share ``threshold`` of the score the piece gives itself.
Retrieval is block-max WAND with a fixed threshold. A piece's terms stand from
the commonest to the rarest; those before the pivot, which together give no
more than half the threshold, propose nothing. The others propose blocks of
pieces; a block is skipped if the block maxima of its proposing terms and the
most that the terms before a pivot could add stay below the threshold; the
pieces of the other blocks are scored exactly.

A retrieved pair of document and item counts as a leak if, in the whole text,
at least ``overlap`` of the five-word shingles of the question and of the
answer occur. Items without an ``answer`` column: the last quarter of the
words of ``text`` is the answer, the rest the question.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Null
texts and items have no words; items without words match nothing. Repeated
rows each count. An empty table on either side gives an empty result. Columns
besides ``doc_id``, ``text`` and ``item_id``, ``text``, ``answer`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exchange as X
from weftline.llm import words as W

PASSAGE, PIECE, SHINGLE = 128, 64, 5
BLOCK_PIECES = 8
K1, B = 1.2, 0.75
#: Bytes of items in one index; more items are searched in several passes.
INDEX_BYTES = 16 << 20

LEAK = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _shingles(values: np.ndarray) -> np.ndarray:
    """Distinct hashes of the five-word shingles (of all words, if fewer)."""
    if not len(values):
        return np.zeros(0, np.uint64)
    n = min(SHINGLE, len(values))
    at = np.arange(len(values) - n + 1)
    return np.unique(W.span_hash(W.rolling(values, W.BASES[1]), W.BASES[1], at, at + n) ^ np.uint64(n))


@dataclass
class Item:
    item_id: int
    question: np.ndarray  # shingles, and the words of a side in lengths[]
    answer: np.ndarray
    lengths: tuple[int, int]


class Index:
    """Postings of pieces with block maxima. Impacts are shares of the piece's
    own score, so the threshold is a share too. Terms are ranked from the
    commonest (most pieces, then shortest) to the rarest."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]], threshold: float):
        self.threshold = threshold
        self.items: list[Item] = []
        pieces: list[tuple[int, np.ndarray]] = []
        letters: list[np.ndarray] = []
        for item_id, text, answer in rows:
            block = W.Block(pa.array([text or "", answer or ""], pa.string()), lower=True)
            starts, ends, first = block.words(W.MARKS)
            values = block.word_hashes(starts, ends)
            cut = int(first[1]) if answer is not None else len(values) - max(1, len(values) // 4)
            question, reply = values[:cut], values[cut:]
            if not len(values):
                continue
            number = len(self.items)
            self.items.append(Item(item_id, _shingles(question), _shingles(reply), (len(question), len(reply))))
            for at in range(0, max(1, len(values) - PIECE // 2), PIECE // 2):
                pieces.append((number, values[at : at + PIECE]))
                letters.append((ends - starts)[at : at + PIECE])
        n = max(1, len(pieces))
        self.piece_item = np.array([x for x, _ in pieces], dtype=np.int64)
        size = np.array([len(v) for _, v in pieces], dtype=np.float64)
        piece = np.repeat(np.arange(len(pieces)), size.astype(np.int64))
        self.terms, one, term = np.unique(np.concatenate([v for _, v in pieces]) if pieces else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        long = np.concatenate(letters)[one] if letters else one
        pair, tf = np.unique(term * n + piece, return_counts=True)
        term, piece = pair // n, pair % n
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((len(pieces) - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[piece] / (size.mean() if len(size) else 1.0)))
        weight = weight / np.bincount(piece, weights=weight, minlength=len(pieces))[piece]
        order = np.lexsort((long, -df))
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        term = self.rank[term]
        # before a piece's pivot: its commonest terms, which together give half the threshold at most
        turn = np.lexsort((term, piece))
        run = np.cumsum(weight[turn])
        begin = np.flatnonzero(np.diff(piece[turn], prepend=-1))
        run -= np.repeat(run[begin] - weight[turn][begin], np.diff(np.append(begin, len(turn))))
        proposes = np.empty(len(turn), dtype=bool)
        proposes[turn] = run > threshold / 2
        rest = np.bincount(piece[~proposes], weights=weight[~proposes], minlength=len(pieces))
        self.blocks = max(1, -(-len(pieces) // BLOCK_PIECES))
        self.block_rest = np.zeros(self.blocks)
        np.maximum.at(self.block_rest, np.arange(len(pieces)) // BLOCK_PIECES, rest)
        self.all = Postings(term, piece, weight, self.blocks, len(self.terms))
        self.proposing = Postings(term[proposes], piece[proposes], weight[proposes], self.blocks, len(self.terms))
        self.calls = np.diff(self.proposing.term_first) > 0  # terms that propose some block
        bits = max(16, len(self.terms).bit_length() + 6)
        self.shift = np.uint64(64 - bits)
        self.directory = np.searchsorted(self.terms >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.directory).max())

    def lookup(self, values: np.ndarray) -> np.ndarray:
        """Rank of each word's term, -1 if no item has it."""
        out = np.full(len(values), -1)
        slot = (values >> self.shift).astype(np.int64)
        at, stop = self.directory[slot], self.directory[slot + 1]
        open_ = np.flatnonzero(at < stop)
        for step in range(self.most):
            here = at[open_] + step
            hit = self.terms[here] == values[open_]
            out[open_[hit]] = self.rank[here[hit]]
            open_ = open_[~hit & (here + 1 < stop[open_])]
        return out

    def retrieve(self, passage: np.ndarray, term: np.ndarray, terms_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, piece, score) at or over the threshold. passage, term: the
        distinct pairs whose terms propose; terms_of: all distinct pairs of
        some passages, ordered."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        floor = self.threshold - 1e-9
        lo, hi = self.proposing.term_first[term], self.proposing.term_first[term + 1]
        entry = _ragged(lo, hi)
        if not len(entry):
            return none
        key, place = np.unique(np.repeat(passage, hi - lo) * self.blocks + self.proposing.block[entry], return_inverse=True)
        bound = np.bincount(place, weights=self.proposing.block_max[entry]) + self.block_rest[key % self.blocks]
        key = key[bound >= floor]
        if not len(key):
            return none
        # exact scores of the pieces in the blocks that are left
        asked, block = key // self.blocks, key % self.blocks
        passage, term = terms_of(W.unique(asked))
        start, stop = np.searchsorted(passage, asked), np.searchsorted(passage, asked, side="right")
        pair = _ragged(start, stop)
        asked, block = np.repeat(asked, stop - start), np.repeat(block, stop - start)
        want = term[pair] * self.blocks + block
        at = np.minimum(np.searchsorted(self.all.key, want), len(self.all.key) - 1)
        hit = self.all.key[at] == want
        at, asked = at[hit], asked[hit]
        lo, hi = self.all.first[at], self.all.last[at]
        entry = _ragged(lo, hi)
        n = len(self.piece_item)
        key, place = np.unique(np.repeat(asked, hi - lo) * n + self.all.piece[entry], return_inverse=True)
        score = np.bincount(place, weights=self.all.weight[entry])
        good = score >= floor
        return key[good] // n, key[good] % n, score[good]


class Postings:
    """(term, piece, weight) by term, then block of pieces, with each block's greatest weight."""

    def __init__(self, term: np.ndarray, piece: np.ndarray, weight: np.ndarray, blocks: int, terms: int):
        order = np.lexsort((piece, term))
        self.piece, self.weight = piece[order], weight[order]
        self.key, self.first = np.unique(term[order] * blocks + self.piece // BLOCK_PIECES, return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.block = self.key % blocks
        self.block_max = np.maximum.reduceat(self.weight, self.first) if len(order) else np.zeros(0)
        self.term_first = np.searchsorted(self.key // blocks, np.arange(terms + 1))


def _ragged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo .. hi - 1, one range after the other."""
    size = hi - lo
    return np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)


def _share(part: np.ndarray, whole: np.ndarray) -> float:
    return float(np.isin(part, whole).mean()) if len(part) else 1.0


def leaks_of(block: W.Block, index: Index, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(text number, item_id, score, question overlap, answer overlap) of the leaks in a block."""
    starts, ends, first = block.words(W.MARKS)
    values = block.word_hashes(starts, ends)
    rank = index.lookup(values)
    half, n_terms = PASSAGE // 2, max(1, len(index.terms))
    count = np.maximum(-(-np.diff(first) // half), 1)  # halves of a text; a passage is two of them
    base = np.cumsum(count) - count

    def pairs(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both passages of each word, and its term."""
        part = (words - first[doc]) // half
        at = base[doc] + part
        earlier = part > 0
        return np.concatenate([at, at[earlier] - 1]), np.concatenate([rank[words], rank[words][earlier]])

    def terms_of(passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = np.searchsorted(base, passages, side="right") - 1
        lo = first[doc] + (passages - base[doc]) * half
        hi = np.minimum(lo + PASSAGE, first[doc + 1])
        words, at = _ragged(lo, hi), np.repeat(passages, hi - lo)
        known = rank[words] >= 0
        pair = W.unique(at[known] * n_terms + rank[words[known]])
        return pair // n_terms, pair % n_terms

    calling = np.flatnonzero((rank >= 0) & index.calls[rank]) if len(index.terms) else np.zeros(0, np.int64)
    passage, term = pairs(calling, np.searchsorted(first, calling, side="right") - 1)
    pair = W.unique(passage * n_terms + term)
    passage, piece, score = index.retrieve(pair // n_terms, pair % n_terms, terms_of)
    owner = np.searchsorted(base, passage, side="right") - 1
    found: dict[tuple[int, int], float] = {}
    for d, p, s in zip(owner.tolist(), index.piece_item[piece].tolist(), score.tolist(), strict=True):
        found[d, p] = max(s, found.get((d, p), 0.0))
    out, made, at_doc = [], {}, -1
    for (d, p), s in sorted(found.items()):
        if d != at_doc:
            made, at_doc = {}, d
        item, own = index.items[p], values[first[d] : first[d + 1]]
        shares = []
        for side, n in ((item.question, item.lengths[0]), (item.answer, item.lengths[1])):
            n = min(n, SHINGLE)
            if n and n not in made:
                places = np.arange(max(0, len(own) - n + 1))
                made[n] = W.span_hash(W.rolling(own, W.BASES[1]), W.BASES[1], places, places + n) ^ np.uint64(n)
            shares.append(_share(side, made[n]) if n else 1.0)
        if min(shares) >= overlap:
            out.append((d, item.item_id, s, shares[0], shares[1]))
    return out


def _parts(items: DataFrame) -> tuple[DataFrame, int]:
    """The items, and in how many parts each keeps to INDEX_BYTES (a single item may exceed it)."""
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.cast("string").alias("answer"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0))).alias("n")).first()["n"] or 0
    return rows, max(1, -(-total // INDEX_BYTES))


def _in_turn(items: DataFrame, threshold: float, search: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """What ``search`` finds with the index of each part of the items. Of several
    parts, each one's rows are written down and its index is given up before
    the next is made, so the driver and the executors hold one at a time."""
    rows, parts = _parts(items)
    for k in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        shared = items.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"], r["answer"]) for r in own.toLocalIterator()], threshold))
        found = search(shared)
        if parts == 1:
            yield found
        else:
            yield X.cut(found)
            shared.destroy()


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every leak."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def with_index(shared: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in W.slices(whole):
                    found = leaks_of(W.Block(batch.column("text"), lower=True), shared.value, overlap)
                    ids = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.int64()), *(pa.array([x[k] for x in found], pa.float64()) for k in (2, 3, 4))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return texts.mapInArrow(search, LEAK)

    return X.union(list(_in_turn(items, threshold, with_index)))


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """The rows of docs that hold no leak, with all their columns."""

    def with_index(shared: Broadcast) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in W.slices(whole):
                    clean = np.ones(batch.num_rows, dtype=bool)
                    clean[[x[0] for x in leaks_of(W.Block(batch.column("text"), lower=True), shared.value, overlap)]] = False
                    yield batch.filter(pa.array(clean))

        return docs.mapInArrow(keep, docs.schema)

    for left in _in_turn(items, threshold, with_index):
        docs = left
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
