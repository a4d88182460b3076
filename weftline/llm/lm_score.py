"""Operator 7: language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions; a decision's context is the bits decided
so far and the up to ``depth`` bytes before. Each node of the context tree has
a Krichevsky-Trofimov estimate of its decision, and weighting mixes the
estimates of all depths with the posterior weights that the training texts
give them. A text's score is the log10 probability of its bytes and its end.

How it runs: blocks of texts count their distinct (context, byte) grams and
their distinct words (``exchange``). Words go to buckets by their hash, grams by
a hash of the last four bytes of their context, so all grams of a subtree below
depth four meet in one bucket; buckets grow in number with the corpus, and a
subtree holds at most what three further bytes can tell apart. A bucket adds the
counts up and weights its subtrees bottom up; their roots, rows of a table, meet
by their last two bytes and are weighted up to depth two; those few nodes (at
most 65,536 contexts, whatever the corpus) meet once. The mixtures go down the
same way and back to the blocks. The model so grows with what the texts hold.

Base score: words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased and one end, each
log10((c + 1) / (N + V + 1)). A word is known by a 64-bit hash.

Rows: each row is a text of its own. Null texts are empty (one end). A null id
is not held out. An empty table gives an empty result. Columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exchange as X
from weftline.llm import words as W

DEPTH = 5
#: Depths at which the tree is cut into subtrees, and at which these are brought together.
LOWER, UPPER = 4, 2
#: Bytes of texts that are dealt to a block, and that a task handles at once.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
END_BYTE = 0xFF  # in no UTF-8 text
END_WORD = np.uint64(0x5EED0E4DC0FFEE01)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, n_bytes long"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


# --- estimates --------------------------------------------------------------

_SMALL = np.array([math.lgamma(max(k, 1) / 2) for k in range(65)])  # lgamma(k / 2)


def _lgamma_half(k: np.ndarray) -> np.ndarray:
    """lgamma(k / 2) for whole k >= 1 (floats)."""
    x = np.maximum(k, 65) / 2
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(k < 65, _SMALL[np.minimum(k, 64).astype(np.int64)], big)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma_half(2 * n0 + 1) + _lgamma_half(2 * n1 + 1) - _lgamma_half(2 * (n0 + n1) + 2) - math.log(math.pi)


class Nodes:
    """Nodes of one depth: id = context bytes (the last byte highest) << 8 | bits
    so far with a leading one; counts; log of estimate and of weighted probability."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.ids, self.n0, self.n1 = ids, n0, n1
        self.own = kt_log(n0, n1)
        self.weighted = self.own if below is None else np.logaddexp(self.own, below) - math.log(2)
        self.stop = np.ones(len(ids)) if below is None else np.exp(self.own - math.log(2) - self.weighted)
        self.one = (n1 + 0.5) / (n0 + n1 + 1)

    def parents(self) -> tuple[Nodes, np.ndarray]:
        """The nodes one byte of context shorter, and each node's place among them."""
        up = (self.ids >> np.uint64(16) << np.uint64(8)) | (self.ids & np.uint64(255))
        ids, place = np.unique(up, return_inverse=True)
        add = lambda x: np.bincount(place, weights=x, minlength=len(ids))
        return Nodes(ids, add(self.n0), add(self.n1), add(self.weighted)), place


def leaves(keys: np.ndarray, counts: np.ndarray) -> tuple[Nodes, np.ndarray]:
    """The deepest nodes of the grams, and for each gram its eight nodes."""
    symbol, context = (keys & np.uint64(255)).astype(np.int64), keys >> np.uint64(8) << np.uint64(8)
    ids = np.stack([context | ((1 << j) | (symbol >> (8 - j))).astype(np.uint64) for j in range(8)])
    bit = np.stack([(symbol >> (7 - j)) & 1 for j in range(8)])
    unique, place = np.unique(ids.reshape(-1), return_inverse=True)
    place = place.reshape(8, -1)
    weight = np.broadcast_to(counts.astype(np.float64), bit.shape)
    one = np.bincount(place.reshape(-1), weights=(weight * bit).reshape(-1), minlength=len(unique))
    zero = np.bincount(place.reshape(-1), weights=(weight * (1 - bit)).reshape(-1), minlength=len(unique))
    return Nodes(unique, zero, one, None), place


def climb(nodes: Nodes, steps: int) -> list[tuple[Nodes, np.ndarray]]:
    """(nodes, places of the level below) going up ``steps`` bytes."""
    out = []
    for _ in range(steps):
        nodes, place = nodes.parents()
        out.append((nodes, place))
    return out


def descend(levels: list[tuple[Nodes, np.ndarray | None]], sure: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry (mass of a one so far, weight left) from above the first level down
    through the levels (each: nodes, place of the nodes in the level above or None)."""
    for nodes, place in levels:
        if place is not None:
            sure, left = sure[place], left[place]
        sure = sure + left * nodes.stop * nodes.one
        left = left * (1 - nodes.stop)
    return sure, left


def gram_logs(keys: np.ndarray, leaf_place: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's byte from its nodes' chance of a one."""
    symbol = (keys & np.uint64(255)).astype(np.int64)
    total = np.zeros(len(keys))
    for j in range(8):
        p = one[leaf_place[j]]
        total += np.log10(np.where((symbol >> (7 - j)) & 1, p, 1 - p))
    return total


# --- blocks ------------------------------------------------------------------


def _grams(block: W.Block, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram of every byte and end: context (the last byte highest), then the
    byte; and for each text where its grams begin. A text starts after zeros."""
    n, size = len(block), np.diff(block.offsets)
    pad = depth + 1
    line = np.zeros(len(block.data) + n * pad, dtype=np.uint8)
    line[np.arange(len(block.data)) + np.repeat(np.arange(n) * pad + depth, size)] = block.data
    ends = block.offsets[1:] + np.arange(n) * pad + depth
    line[ends] = END_BYTE
    first = np.concatenate([[0], np.cumsum(size + 1)])
    m = len(line) - depth
    key = np.zeros(m, dtype=np.uint64)
    for back in range(1, depth + 1):
        key <<= np.uint64(8)
        key |= line[depth - back : depth - back + m]
    key <<= np.uint64(8)
    key |= line[depth : depth + m]
    at = np.arange(int(first[-1])) + np.repeat(np.arange(n) * depth, size + 1)
    return key[at], first


def _tokens(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and end; and for each text where its tokens begin."""
    lower = W.Block.__new__(W.Block)
    lower.data, lower.offsets = W.lowered(block.data), block.offsets
    starts, ends, first = lower.words()
    values = lower.word_hashes(starts, ends)
    return np.insert(values, first[1:], END_WORD), first + np.arange(len(block) + 1)


def _counted(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some pieces (keys, where each text's begin, whether to
    learn from it) and how often each stands in the texts to learn from."""
    all_, count = [], []
    for key, first, learn in parts:
        own = np.repeat(learn, np.diff(first))
        if len(key) and int(key.max()) >> 63:
            unique = W.unique(key)
            known, n = W.unique(key[own], counts=True)
            out = np.zeros(len(unique), dtype=np.uint64)
            out[np.searchsorted(unique, known)] = n.astype(np.uint64)
        else:  # one sort for both
            marked, n = W.unique(key << np.uint64(1) | own.astype(np.uint64), counts=True)
            n = np.where(marked & np.uint64(1), n, 0).astype(np.uint64)
            marked >>= np.uint64(1)
            begin = np.flatnonzero(np.diff(marked, prepend=marked[:1] ^ np.uint64(1)))
            unique, out = marked[begin], np.add.reduceat(n, begin) if len(begin) else n
        all_.append(unique)
        count.append(out)
    unique, place = np.unique(np.concatenate(all_), return_inverse=True)
    return unique, np.bincount(place, weights=np.concatenate(count).astype(np.float64), minlength=len(unique)).astype(np.uint64)


def _places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place of each key among them."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(key), dtype=np.int32)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def _bucket(key: np.ndarray, seed: int, buckets: int) -> np.ndarray:
    return (W.mix(key, seed) % np.uint64(buckets)).astype(np.int64)


# --- levels of the tree --------------------------------------------------------


def _level(table: pa.Table) -> Nodes:
    """Nodes from rows of id, n0, n1 and weighted, by id."""
    ids = np.asarray(table.column("id")).view(np.uint64)
    order = np.argsort(ids)
    n0, n1, weighted = (np.asarray(table.column(c))[order] for c in ("n0", "n1", "weighted"))
    level = Nodes(ids[order], n0, n1, None)
    level.weighted = weighted
    return level


def _from_above(levels: list[tuple[Nodes, np.ndarray | None]], above: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The levels' mixtures, for the nodes of the first level: (mass of a one, weight
    left) below the last level, given those above it (rows of id, sure, left).
    levels: from the deepest up, each with the places of the level below."""
    ids = np.asarray(above.column("id")).view(np.uint64)
    order = np.argsort(ids)
    at = order[np.searchsorted(ids[order], levels[-1][0].ids)]
    sure, left = np.asarray(above.column("sure"))[at], np.asarray(above.column("left"))[at]
    return descend([(levels[k][0], levels[k + 1][1] if k + 1 < len(levels) else None) for k in range(len(levels) - 1, -1, -1)], sure, left)


def score_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens (N), train_vocabulary
    (V), base_score, score, bits_per_byte of every row of docs."""
    if not UPPER <= depth <= 7:
        raise ValueError("depth must be from 2 to 7 bytes")
    spark = docs.sparkSession
    total = X.text_bytes(docs)
    texts, _ = X.dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")), ["doc_id", "text", "held_out"], total, BLOCK_BYTES)
    buckets = X.bucket_count(spark, total // 20)
    groups = min(1 << 16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lower = min(LOWER, depth)
    beyond, above_upper = np.uint64(8 * (depth - lower + 1)), np.uint64(8 * (lower - UPPER + 1))

    def token_bucket(key: np.ndarray) -> np.ndarray:
        return _bucket(key, 41, buckets)

    def gram_bucket(key: np.ndarray) -> np.ndarray:
        return _bucket(key >> beyond, 43, buckets) + buckets

    kinds = ((token_bucket, _tokens), (gram_bucket, lambda block: _grams(block, depth)))

    def pieces(table: pa.Table) -> Iterator[tuple[W.Block, np.ndarray]]:
        """A block's texts, few at a time, and whether to learn from them."""
        for whole in table.combine_chunks().to_batches():
            for batch in W.slices(whole, limit=PIECE_BYTES):
                yield W.Block(batch.column("text")), ~np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)

    def pack(table: pa.Table) -> pa.Table:
        number, parts = table.column("block")[0].as_py(), []
        for place, keys in kinds:
            key, count = _counted((*keys(block), learn) for block, learn in pieces(table))
            bucket = place(key)
            order = np.argsort(bucket, kind="stable")
            parts.append(X.packed(number, bucket[order], key[order], count[order], X.planes_of_steps, X.planes))
        return pa.concat_tables(parts)

    by_bucket = texts.groupBy("block").applyInArrow(pack, X.PACKED).groupBy("bucket")

    def added(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """How many keys each packed row has; the distinct keys, the place of each key among them, and their counts."""
        keys = [X.from_planes_of_steps(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([X.from_planes(x, np.uint64) for x in table.column("extra").to_pylist()])
        unique, place = _places(np.concatenate(keys))
        return [len(k) for k in keys], unique, place, np.bincount(place, weights=counts, minlength=len(unique))

    def rows_of(group: np.ndarray, *cols: np.ndarray, names: tuple[str, ...]) -> pa.Table:
        return pa.table([pa.array(group.astype(np.int32)), pa.array(cols[0].view(np.int64)), *(pa.array(c) for c in cols[1:])], list(names))

    up_names, down_names = ("group", "id", "n0", "n1", "weighted"), ("group", "id", "sure", "left")
    up_schema, down_schema = "group int, id long, n0 double, n1 double, weighted double", "group int, id long, sure double, left double"

    def bottom(table: pa.Table) -> pa.Table:
        """The roots of a bucket's subtrees."""
        if table.column("bucket")[0].as_py() < buckets:
            return rows_of(*(np.zeros(0, x) for x in (np.int64, np.uint64, np.float64, np.float64, np.float64)), names=up_names)
        _, unique, _, count = added(table)
        leaf = leaves(unique, count)[0]
        nodes = [leaf, *(x for x, _ in climb(leaf, depth - lower))][-1]
        return rows_of(_bucket(nodes.ids >> above_upper, 44, groups), nodes.ids, nodes.n0, nodes.n1, nodes.weighted, names=up_names)

    by_group = by_bucket.applyInArrow(bottom, up_schema).groupBy("group")

    def totals(table: pa.Table) -> pa.Table:
        """Tokens and distinct tokens of a bucket of words."""
        count = added(table)[3] if table.column("bucket")[0].as_py() < buckets else np.zeros(0)
        return pa.table({"n": pa.array([int(count.sum())], pa.int64()), "v": pa.array([int((count > 0).sum())], pa.int64())})

    def middle_up(table: pa.Table) -> pa.Table:
        level = _level(table)
        nodes = [level, *(x for x, _ in climb(level, lower - UPPER))][-1]
        return rows_of(np.repeat(table.column("group")[0].as_py(), len(nodes.ids)), nodes.ids, nodes.n0, nodes.n1, nodes.weighted, names=up_names)

    def top(table: pa.Table) -> pa.Table:
        """From the root down to the depth above ``UPPER``, for each node of that depth."""
        level = _level(table)
        group = np.asarray(table.column("group"))[np.argsort(np.asarray(table.column("id")).view(np.uint64))]
        up = climb(level, UPPER)
        root = up[-1][0].ids.view(np.int64)
        start = pa.table({"id": root, "sure": np.zeros(len(root)), "left": np.ones(len(root))})
        sure, left = (x[up[0][1]] for x in _from_above(up, start))
        return rows_of(group, level.ids, sure, left, names=down_names)

    above = by_group.applyInArrow(middle_up, up_schema).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: top(t.drop_columns(["all"])), down_schema)

    def middle_down(table: pa.Table, above: pa.Table) -> pa.Table:
        level = _level(table)
        up = climb(level, lower - UPPER)
        if up:
            sure, left = (x[up[0][1]] for x in _from_above(up, above))
        else:
            order = np.argsort(np.asarray(above.column("id")).view(np.uint64))
            sure, left = (np.asarray(above.column(c))[order] for c in ("sure", "left"))
        return rows_of(_bucket(level.ids >> np.uint64(8), 43, buckets) + buckets, level.ids, sure, left, names=down_names)

    down = by_group.cogroup(above.groupBy("group")).applyInArrow(middle_down, down_schema)

    def answers(table: pa.Table, above: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.answers(table.select(["block", "bucket"]), [])
        sizes, unique, place, count = added(table)
        cuts = np.cumsum(sizes)[:-1]
        if table.column("bucket")[0].as_py() < buckets:
            return X.answers(table, [X.planes(x) for x in np.split(count[place].astype(np.uint64), cuts)])
        leaf, leaf_place = leaves(unique, count)
        sure, _ = _from_above([(leaf, None), *climb(leaf, depth - lower)], above)
        logs = gram_logs(unique, leaf_place, sure).astype(np.float32)
        return X.answers(table, [X.planes(x) for x in np.split(logs[place], cuts)])

    replies = by_bucket.cogroup(down.groupBy("group")).applyInArrow(answers, X.ANSWER)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = sorted(zip(replies.column("bucket").to_pylist(), replies.column("answer").to_pylist(), strict=True))
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "log_counts", "score", "n_bytes")}
        for (bucket_of, keys), kind, mine in zip(kinds, (np.uint64, np.float32), ([x for b, x in rows if b < buckets], [x for b, x in rows if b >= buckets]), strict=True):
            parts = [(*_places(key), first) for key, first in (keys(block) for block, _ in pieces(table))]
            unique = W.unique(np.concatenate([x for x, _, _ in parts]))
            value = np.zeros(len(unique), dtype=kind)
            value[np.argsort(bucket_of(unique), kind="stable")] = np.concatenate([X.from_planes(x, kind) for x in mine])
            for own, place, first in parts:
                each = value[np.searchsorted(unique, own)][place]
                n = len(first) - 1
                doc = np.repeat(np.arange(n), np.diff(first))
                if kind is np.uint64:
                    out["n_tokens"].append(np.diff(first))
                    out["n_known"].append(np.bincount(doc, weights=each > 0, minlength=n).astype(np.int64))
                    out["log_counts"].append(np.bincount(doc, weights=np.log10(each + 1.0), minlength=n))
                else:
                    out["score"].append(np.bincount(doc, weights=each, minlength=n))
                    out["n_bytes"].append(np.diff(first) - 1)
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), **{k: pa.array(np.concatenate(v)) for k, v in out.items()}})

    scored = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, SCORED)
    sums = by_bucket.applyInArrow(totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    counted = scored.withColumn("sums", sums.select(F.struct("n", "v")).scalar())
    train, words = F.col("sums.n"), F.col("sums.v")
    base = F.col("log_counts") - F.col("n_tokens") * F.log10((train + words + 1).cast("double"))
    bits = -F.col("score") / math.log10(2) / F.greatest("n_bytes", F.lit(1))
    return counted.select("doc_id", "held_out", "n_tokens", "n_known", train.alias("train_tokens"), words.alias("train_vocabulary"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
