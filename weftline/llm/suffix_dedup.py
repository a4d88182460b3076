"""Operator 4: removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a ``length``-byte string (400) that also starts
anywhere else in the corpus, in the same document too. Matches never cross
documents.

Where to look: in every ``length``-byte window the 128-byte gram with the
least hash is the window's anchor, so equal windows have equal anchors, at the
same place. Anchors that occur once settle all their windows; the stretches
around the others (*contexts*: the windows of one anchor occurrence) are
brought together by anchor.

Who is repeated: the contexts of a bucket become one suffix array by two-stage
sorting. Only suffixes smaller than their successors are sorted directly, on
``length`` bytes; every other suffix is induced by scanning the buckets of
first bytes in order, each bucket as a whole. Then the common prefixes of
neighbours are computed, and windows with ``length`` bytes in common with a
neighbour are repeated.

An anchor with more than ``HOT`` occurrences would bring an unbounded group
into one bucket. Its windows are spread by their own Rabin-Karp hash instead
and counted (``exchange``), one entry for each block and distinct window.

Rows: each row is a document of its own. Null texts are empty. Texts shorter
than ``length`` lose nothing. An empty table gives an empty result. Columns
besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exchange as X
from weftline.llm import words as W

GRAM, HOT = 128, 4096
SEPARATOR = 0xFF  # in no UTF-8 text
PARTS = "bucket int, block int, at binary, data binary"
REPLY = "block int, at binary"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary, kept_sha256 string"


# --- two-stage suffix sorting ---------------------------------------------------


def big_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for j in range(8):
        out <<= np.uint64(8)
        out |= padded[j : j + len(data)]
    return out


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one: the first
    byte that differs from the byte here is larger. (The last place: no.)"""
    n = len(data)
    change = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    end = np.repeat(change, np.diff(change, prepend=-1))
    follower = np.append(data, 0)[end + 1].astype(np.int16)
    return follower > data


def sort_directly(places: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Places in the order of their first ``length`` bytes, eight at a time;
    each round goes on only with places that are tied so far."""
    pad = np.concatenate([words, np.zeros(length + 8, np.uint64)])
    order = places[np.argsort(pad[places], kind="stable")]
    key = pad[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    for depth in range(8, length, 8):
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key, own = pad[order[tied] + depth], group[tied]
        turn = np.lexsort((key, own))
        order[tied] = order[tied][turn]
        key = key[turn]
        split = np.zeros(len(tied), dtype=bool)
        split[1:] = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        new[tied] |= split
    return order


def two_stage(data: np.ndarray, member: np.ndarray, length: int) -> np.ndarray:
    """The places marked in ``member`` in suffix order (on at least ``length``
    bytes). A marked place that isn't smaller than its successor needs the
    successor marked too."""
    small = smaller_than_successor(data)
    direct = sort_directly(np.flatnonzero(member & small), big_words(data), length)
    edges = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def hand_on(row: np.ndarray, here: int) -> np.ndarray:
        """Give each suffix's predecessor, if it is larger, to its bucket; those of this bucket are returned."""
        before = row[row > 0] - 1
        before = before[member[before] & ~small[before]]
        if not len(before):
            return before
        first = data[before]
        turn = np.argsort(first, kind="stable")
        before, first = before[turn], first[turn]
        cuts = np.flatnonzero(np.diff(first)) + 1
        same = before[:0]
        for part in np.split(before, cuts):
            c = int(data[part[0]])
            if c == here:
                same = part
            else:
                induced[c].append(part)
        return same

    for c in range(256):
        row = np.concatenate(induced[c]) if induced[c] else direct[:0]
        while len(row):
            out.append(row)
            row = hand_on(row, c)
        row = direct[edges[c] : edges[c + 1]]
        if len(row):
            out.append(row)
            hand_on(row, c)
    return np.concatenate(out) if out else direct


def neighbours_share(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """For each place in order: whether its common prefix with the one before
    or after has ``length`` bytes."""
    pad = np.concatenate([words, np.zeros(length + 8, np.uint64)])
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), dtype=np.int64)  # of neighbours, in bytes
    open_ = np.arange(len(a))
    for depth in range(0, length, 8):
        differ = pad[a[open_] + depth] ^ pad[b[open_] + depth]
        mask = np.uint64(0xFFFFFFFFFFFFFFFF)
        if depth + 8 > length:
            mask = np.uint64(((1 << (8 * (length - depth))) - 1) << (8 * (8 - (length - depth))))
        open_ = open_[(differ & mask) == 0]
        common[open_] = min(depth + 8, length)
        if not len(open_):
            break
    full = common >= length
    out = np.zeros(len(order), dtype=bool)
    out[:-1] |= full
    out[1:] |= full
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct texts (at least ``length`` bytes each): whether
    the window at each start occurs again in any of them."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(size + 1) - (size + 1)
    data = np.frombuffer(bytes([SEPARATOR]).join(texts) + bytes([SEPARATOR]), dtype=np.uint8)
    starts = size - length + 1
    small = smaller_than_successor(data)
    # beyond the last start, up to the next suffix that is sorted directly: at the
    # latest the text's last byte, for the separator after it is larger
    stops = np.flatnonzero(small)
    last = first + starts - 1
    chain = stops[np.searchsorted(stops, last)]
    step = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, chain + 1, -1)
    member = np.cumsum(step[:-1]) > 0
    order = two_stage(data, member, length)
    step[:] = 0
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    order = order[valid[order]]
    again = np.zeros(len(data), dtype=bool)
    again[order] = neighbours_share(order, big_words(data), length)
    return [again[a : a + n] for a, n in zip(first.tolist(), starts.tolist(), strict=True)]


# --- blocks -----------------------------------------------------------------------


def _sorted_block(table: pa.Table) -> tuple[pa.Table, W.Block]:
    """The block's rows in an order that doesn't depend on how they arrived."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table, W.Block(table.column("text"))


def _anchors(block: W.Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, gram hash) of the runs of windows with one anchor."""
    starts = W.windows(block.offsets, length)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, np.zeros(0, np.uint64)
    prefix = W.rolling(W._BYTE_KEY[block.data], W.BASES[0])
    gram = W.mix(W.equal_spans(prefix, W.BASES[0], GRAM))
    del prefix
    low = gram & np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(len(low), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(starts)) - 1
    return starts[begin], starts[end], gram[anchor[begin]]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (W.mix(key, 51) % np.uint64(buckets)).astype(np.int64)


def _counts(table: pa.Table) -> pa.Table:
    """Answer of a bucket: in how many places each packed key stands, over all blocks."""
    keys = X.unpacked(table, "keys")
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(X.unpacked(table, "extra", np.uint32)), minlength=len(unique))
    total = np.minimum(total, HOT + 1).astype(np.uint16)
    return X.answers(table, [x.tobytes() for x in np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])])


def _runs(places: np.ndarray) -> bytes:
    """First and last of every run of consecutive places."""
    places = W.unique(np.asarray(places, np.int64))
    gap = np.flatnonzero(np.diff(places) > 1)
    first, last = np.append(places[:1], places[gap + 1]), np.append(places[gap], places[-1:])
    return np.column_stack([first, last]).astype(np.uint32).tobytes()


def _reply(blocks: list[int], places: list[np.ndarray]) -> pa.Table:
    return pa.table({"block": pa.array(blocks, pa.int32()), "at": pa.array([_runs(x) for x in places], pa.binary())})


def remove_repeated_strings(docs: DataFrame, length: int = 400, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_text
    (the remaining bytes, null unless ``keep_text``) and kept_sha256 of every row."""
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes at least")
    spark = docs.sparkSession
    total = X.text_bytes(docs)
    texts, _ = X.dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], total, 2 << 20)
    key_buckets = X.bucket_count(spark, total // 100)
    buckets = X.bucket_count(spark, total, 2 << 20)

    def pack(table: pa.Table) -> pa.Table:
        _, _, gram = _anchors(_sorted_block(table)[1], length)
        key, count = W.unique(gram, counts=True)
        bucket = _bucket(key, key_buckets)
        order = np.argsort(bucket, kind="stable")
        return X.packed(table.column("block")[0].as_py(), bucket[order], key[order], count[order].astype(np.uint32))

    def contexts(table: pa.Table, replies: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        _, block = _sorted_block(table)
        lo, hi, gram = _anchors(block, length)
        key, place = np.unique(gram, return_inverse=True)
        total = np.zeros(len(key), dtype=np.uint16)
        if len(key):
            total[np.argsort(_bucket(key, key_buckets), kind="stable")] = X.joined(replies, np.uint16)
        often = total[place]
        rows: list[tuple[int, np.ndarray, bytes]] = []
        sure: list[np.ndarray] = []
        # contexts of anchors that occur again; equal ones of a block go once
        pick = np.flatnonzero((often > 1) & (often <= HOT))
        seen: dict[bytes, np.ndarray | None] = {}
        goal = _bucket(gram[pick], buckets)
        for k, b in zip(pick.tolist(), goal.tolist(), strict=True):
            data = block.data[lo[k] : hi[k] + length].tobytes()
            run = np.arange(lo[k], hi[k] + 1)
            if data in seen:
                sure.append(run)
                first = seen[data]
                if first is not None:
                    sure.append(first)
                    seen[data] = None
            else:
                seen[data] = run
                rows.append((b, lo[k : k + 1], data))
        # windows of anchors that occur very often: by their own hash
        pick = np.flatnonzero(often > HOT)
        if len(pick):
            at = np.concatenate([np.arange(lo[k], hi[k] + 1) for k in pick.tolist()])
            prefix = W.rolling(W._BYTE_KEY[block.data], W.BASES[1])
            window = W.mix(W.span_hash(prefix, W.BASES[1], at, at + length))
            other = W.span_hash(W.rolling(W.mix(W._BYTE_KEY, 9)[block.data], W.BASES[2]), W.BASES[2], at, at + length)
            bucket, keys, where = X.distinct(_bucket(other, buckets), window)
            twice = np.bincount(where, minlength=len(keys)) > 1
            sure.append(at[twice[where]])
            first = np.zeros(len(keys), dtype=np.uint32)
            first[where] = at
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for b, k, f in zip(np.split(bucket, cuts), np.split(keys, cuts), np.split(first, cuts), strict=True):
                rows.append((buckets + int(b[0]), f, k.tobytes()))
        if sure:
            rows.append((2 * buckets + number % buckets, np.frombuffer(_runs(np.concatenate(sure)), np.uint32), b""))
        return pa.table({"bucket": pa.array([b for b, _, _ in rows], pa.int32()), "block": pa.array([number] * len(rows), pa.int32()), "at": pa.array([np.asarray(a, np.uint32).tobytes() for _, a, _ in rows], pa.binary()), "data": pa.array([d for _, _, d in rows], pa.binary())})

    def settle(table: pa.Table) -> pa.Table:
        kind = table.column("bucket")[0].as_py() // buckets
        blocks, data = table.column("block").to_pylist(), table.column("data").to_pylist()
        at = [np.frombuffer(x, np.uint32) for x in table.column("at").to_pylist()]
        if kind == 2:
            return table.select(["block", "at"])
        if kind == 1:
            keys = [np.frombuffer(x, np.uint64) for x in data]
            _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            again = np.split((count > 1)[place], np.cumsum([len(k) for k in keys])[:-1])
            return _reply(blocks, [a[g] for a, g in zip(at, again, strict=True)])
        same: dict[bytes, list[int]] = {}
        for i, x in enumerate(data):
            same.setdefault(x, []).append(i)
        distinct = list(same)
        found = repeated_windows(distinct, length)
        out = {}
        for x, again in zip(distinct, found, strict=True):
            for i in same[x]:
                hit = np.flatnonzero(again) if len(same[x]) == 1 else np.arange(len(again))
                if len(hit):
                    out.setdefault(blocks[i], []).append(int(at[i][0]) + hit)
        return _reply(list(out), [np.concatenate(v) for v in out.values()])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        table, block = _sorted_block(table)
        runs = np.frombuffer(b"".join(replies.column("at").to_pylist()), np.uint32).astype(np.int64).reshape(-1, 2)
        step = np.zeros(len(block.data) + 1, dtype=np.int64)
        np.add.at(step, runs[:, 0], 1)
        np.add.at(step, runs[:, 1] + length, -1)
        gone = np.cumsum(step[:-1]) > 0
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256")}
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
            mask = gone[a:b]
            removed = int(mask.sum())
            kept = (block.data[a:b][~mask] if removed else block.data[a:b]).tobytes()
            out["n_bytes"].append(b - a)
            out["n_removed"].append(removed)
            out["n_spans"].append(int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum()))
            out["kept_text"].append(kept if keep_text else None)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"), **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}, "kept_text": pa.array(out["kept_text"], pa.binary()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})

    by_block = texts.groupBy("block")
    counts = by_block.applyInArrow(pack, X.PACKED).groupBy("bucket").applyInArrow(_counts, X.ANSWER)
    parts = by_block.cogroup(counts.groupBy("block")).applyInArrow(contexts, PARTS)
    replies = parts.groupBy("bucket").applyInArrow(settle, REPLY)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(finish, KEPT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_strings(docs, 400, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: All 400-byte windows by their MD5.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, i, md5(t[i + 1:i + 400]) AS k FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 399)) AS i FROM d WHERE octet_length(t) >= 400)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS times FROM w) WHERE times > 1),
edges AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS opens FROM again),
runs AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM edges),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, max(b) OVER (PARTITION BY doc_id) AS tail FROM spans),
kept AS (
  SELECT doc_id, string_agg(hex(t[since + 1:a]), '' ORDER BY a) || any_value(hex(t[tail + 1:octet_length(t)])) AS h, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(h), t)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
