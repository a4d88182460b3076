"""Operator 5: reversible line dedup.

Exact state: a table of references, for each line key and document id how many
documents with that id hold the line. Inserting documents adds to it, deleting
documents subtracts, and nothing else is kept, so a deletion undoes an
insertion. Summed per key it is the table of reference counts, with the
smallest id (*owner*) of each line. In front of it stand sharded cuckoo filters
over the keys whose count has reached the limit; they take insertions and
deletions too, and grow and shrink with their keys. Each shard also holds its
listed keys and their owners exactly.

How lines are judged: a block of texts sends each of its distinct keys once to
the key's shard. Keys that the shard's filter doesn't know are done with; the
others are confirmed against the shard's exact keys, so the filter never
decides alone, and only the confirmed ones go back to their block. A line that
every document holds costs one entry for each block.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends and with
A-Z lower-cased, held as a 128-bit digest. Each row is a document of its own,
whatever its id; a null or empty text is one empty line. Keys shorter than
``min_chars`` code points are never dropped. An empty table gives an empty
result; columns besides ``doc_id`` and ``text`` are ignored unless carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exchange as X

FILTERS = "shard int, slots binary, stash binary, keys binary, owners binary, unowned binary"
WHITE = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: Listed keys that a shard has on average.
SHARD_KEYS = 100_000


def line_key(line: bytes, min_chars: int = 1) -> bytes | None:
    """The digest of a line's key, or None if the key is too short."""
    key = line.strip(WHITE).lower()
    if not key or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


# --- the exact tables ------------------------------------------------------


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """key and doc_id of every distinct line of every document."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = {line_key(x, min_chars) for x in _encoded(text.as_py()).split(b"\n")} - {None}
                out += own
                ids += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(keys, "key binary, doc_id long")


def line_references(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """key, doc_id and n (documents with that id that hold the line)."""
    return _lines(docs, min_chars).groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def changed_references(references: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, min_chars: int = 1) -> DataFrame:
    """The table after inserting the documents ``added`` and deleting ``removed``."""
    parts = [references.select("key", "doc_id", "n")]
    if added is not None:
        parts.append(line_references(added, min_chars))
    if removed is not None:
        parts.append(line_references(removed, min_chars).withColumn("n", -F.col("n")))
    return X.union(parts).groupBy("key", "doc_id").agg(F.sum("n").alias("n")).filter("n > 0")


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """key, n (documents that hold it) and owner (their smallest doc_id)."""
    return _lines(docs, min_chars).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner"))


def counts_of(references: DataFrame) -> DataFrame:
    """``line_counts`` of the documents that a table of references stands for."""
    return references.groupBy("key").agg(F.sum("n").alias("n"), F.min("doc_id").alias("owner"))


# --- cuckoo filters -------------------------------------------------------


def _halves(keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(keys, dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _split(keys: bytes) -> list[bytes]:
    return [keys[i : i + 16] for i in range(0, len(keys), 16)]


def _fingerprint(second: np.ndarray) -> np.ndarray:
    return ((second >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.int64)


def _jump(fingerprint):
    return (fingerprint * 0x5BD1E995) >> 3


class Cuckoo:
    """One shard: buckets of four 16-bit fingerprints, and a stash of whole
    second halves for keys that found no slot."""

    def __init__(self, buckets: int = 0, slots: bytes | None = None, stash: bytes = b""):
        self.slots = np.frombuffer(slots, np.uint16).copy() if slots is not None else np.zeros(buckets * SLOTS, np.uint16)
        self.stash = set(np.frombuffer(stash, np.uint64).tolist())
        self.mask = len(self.slots) // SLOTS - 1

    @staticmethod
    def buckets_for(n: int) -> int:
        return 1 << max(1, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.8) + 1))))

    def _homes(self, second: int) -> tuple[int, int, int]:
        fp = (second >> 48) % 65535 + 1
        a = second & self.mask
        return fp, a, (a ^ _jump(fp)) & self.mask

    def add(self, second: int) -> None:
        fp, a, b = self._homes(second)
        for at in (a, b):
            for k in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self.slots[k]:
                    self.slots[k] = fp
                    return
        path, at, moved = [], b, fp
        for turn in range(200):
            k = at * SLOTS + turn % SLOTS
            path.append((k, int(self.slots[k])))
            moved, self.slots[k] = int(self.slots[k]), moved
            at = (at ^ _jump(moved)) & self.mask
            for j in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self.slots[j]:
                    self.slots[j] = moved
                    return
        for k, old in reversed(path):  # no room: put all back and remember the key as it is
            self.slots[k] = old
        self.stash.add(second)

    def remove(self, second: int) -> None:
        if second in self.stash:
            self.stash.remove(second)
            return
        fp, a, b = self._homes(second)
        for at in (a, b):
            for k in range(at * SLOTS, at * SLOTS + SLOTS):
                if self.slots[k] == fp:
                    self.slots[k] = 0
                    return

    def fits(self, n: int) -> bool:
        """Whether n keys are neither too many nor far too few for it, and nearly all found a slot."""
        return len(self.slots) // 16 <= max(n, 2 * SLOTS) <= 0.95 * len(self.slots) + 2 * SLOTS and len(self.stash) <= 16

    def holds(self, second: np.ndarray) -> np.ndarray:
        """Whether it knows each of many keys."""
        fp, mask = _fingerprint(second), np.int64(self.mask)
        a = (second & np.uint64(self.mask)).astype(np.int64)
        hit = np.isin(second, np.array(sorted(self.stash), np.uint64)) if self.stash else np.zeros(len(second), bool)
        for home in (a, (a ^ _jump(fp)) & mask):
            for j in range(SLOTS):
                hit |= self.slots[home * SLOTS + j] == fp
        return hit


def _made(seconds: list[int]) -> Cuckoo:
    made = Cuckoo(Cuckoo.buckets_for(len(seconds)))
    for x in seconds:
        made.add(x)
    return made


def _shard_of(key, shards: int):
    """Shard by the digest's first four bytes; ``_sharding`` does the same in numpy."""
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _sharding(keys: bytes, shards: int) -> np.ndarray:
    return (np.frombuffer(keys, dtype=">u4")[::4] % shards).astype(np.int64)


def shards_for(n_listed: int) -> int:
    return max(1, -(-n_listed // SHARD_KEYS))


def build_filters(listed: DataFrame, shards: int, old: DataFrame | None = None) -> DataFrame:
    """A row for each shard that has keys: its cuckoo filter, and its listed
    keys with their owners. listed: key, owner. ``old``: such rows of the same
    number of shards, whose filters then take the keys that came and give up
    those that went; a filter that they don't fit is made anew."""

    def build(before: pa.Table | None, now: pa.Table) -> pa.Table:
        keys, owners = now.column("key").to_pylist(), now.column("owner")
        seconds = dict(zip(keys, _halves(b"".join(keys))[1].tolist(), strict=True))
        if before is None or not before.num_rows:
            filt = _made(list(seconds.values()))
        else:
            filt = Cuckoo(slots=before.column("slots")[0].as_py(), stash=before.column("stash")[0].as_py())
            held = before.column("keys")[0].as_py()
            was = dict(zip(_split(held), _halves(held)[1].tolist(), strict=True))
            for k in was.keys() - seconds.keys():
                filt.remove(was[k])
            for k in seconds.keys() - was.keys():
                filt.add(seconds[k])
            if not filt.fits(len(keys)):
                filt = _made(list(seconds.values()))
        if not keys:
            return pa.table({"shard": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("slots", "stash", "keys", "owners", "unowned")}})
        ids = np.asarray(owners.fill_null(0), dtype=np.int64)
        none = np.asarray(owners.is_null(), dtype=np.uint8)
        row = [filt.slots.tobytes(), np.array(sorted(filt.stash), np.uint64).tobytes(), b"".join(keys), ids.tobytes(), none.tobytes()]
        return pa.table({"shard": pa.array([now.column("shard")[0].as_py()], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip(("slots", "stash", "keys", "owners", "unowned"), row, strict=True)}})

    groups = listed.select(_shard_of(F.col("key"), shards).alias("shard"), "key", F.col("owner").cast("long").alias("owner")).groupBy("shard")
    if old is None:
        return groups.applyInArrow(lambda now: build(None, now), FILTERS)
    return old.groupBy("shard").cogroup(groups).applyInArrow(build, FILTERS)


# --- kept state -------------------------------------------------------------


@dataclass
class LineState:
    """What incremental runs keep: the references, and the shards of the keys at the limit."""

    references: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int = 1

    def save(self, folder: str) -> None:
        """Write it to a new folder."""
        self.references.write.parquet(f"{folder}/references")
        self.filters.write.parquet(f"{folder}/filters")
        spark = self.references.sparkSession
        spark.createDataFrame([(self.shards, self.min_docs, self.min_chars)], "shards int, min_docs int, min_chars int").coalesce(1).write.parquet(f"{folder}/settings")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LineState:
        s = spark.read.parquet(f"{folder}/settings").first()
        return LineState(spark.read.parquet(f"{folder}/references"), spark.read.parquet(f"{folder}/filters"), s["shards"], s["min_docs"], s["min_chars"])


def _listed(counts: DataFrame, min_docs: int) -> DataFrame:
    return X.cut(counts.filter(F.col("n") >= min_docs).select("key", "owner"))


def new_state(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> LineState:
    """The state of these documents."""
    references = X.cut(line_references(docs, min_chars))
    listed = _listed(counts_of(references), min_docs)
    shards = shards_for(listed.count())
    return LineState(references, X.cut(build_filters(listed, shards)), shards, min_docs, min_chars)


def changed_state(state: LineState, added: DataFrame | None = None, removed: DataFrame | None = None) -> LineState:
    """The state after inserting and deleting documents. The filters take the
    changes; only when their number doesn't suit any more are they made anew."""
    references = X.cut(changed_references(state.references, added, removed, state.min_chars))
    listed = _listed(counts_of(references), state.min_docs)
    shards = shards_for(listed.count())
    same = state.shards <= 2 * shards and shards <= 2 * state.shards
    filters = build_filters(listed, state.shards, state.filters) if same else build_filters(listed, shards)
    return LineState(references, X.cut(filters), state.shards if same else shards, state.min_docs, state.min_chars)


# --- the operator ---------------------------------------------------------


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_owner: bool = False, carry: list[str] | None = None, state: LineState | None = None) -> DataFrame:
    """doc_id, the carried columns, n_lines, n_dropped, kept_text, kept_sha256.

    A key found in ``min_docs`` documents or more loses all its lines; with
    ``keep_owner`` they stay in the rows with the smallest id that holds them.
    ``state``: judge by what an earlier run kept (with its limits), else by docs
    themselves."""
    carry = carry or []
    total = X.text_bytes(docs)
    if state is None:
        listed = _listed(line_counts(docs, min_chars), min_docs)
        shards = shards_for(listed.count())
        filters = X.cut(build_filters(listed, shards))
    else:
        filters, shards, min_chars = state.filters, state.shards, state.min_chars
    carried = F.struct(*carry) if carry else F.lit(None).cast("string")
    texts, _ = X.dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", carried.alias("carried")), ["doc_id", "text", "carried"], total)

    def pack(table: pa.Table) -> pa.Table:
        own = {line_key(x, min_chars) for text in table.column("text") for x in set(_encoded(text.as_py()).split(b"\n"))} - {None}
        keys = sorted(own)
        shard = _sharding(b"".join(keys), shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        parts = np.split(order, cuts) if len(order) else []
        return pa.table({"block": pa.array(table.column("block").to_pylist()[:1] * len(parts), pa.int32()), "shard": pa.array([int(shard[p[0]]) for p in parts], pa.int32()), "asked": pa.array([b"".join(keys[i] for i in p.tolist()) for p in parts], pa.binary())})

    def confirm(asked: pa.Table, shard: pa.Table) -> pa.Table:
        """The keys of each block that the shard lists."""
        out: dict[str, list] = {c: [] for c in ("block", "keys", "owners", "unowned")}
        if asked.num_rows and shard.num_rows:
            filt = Cuckoo(slots=shard.column("slots")[0].as_py(), stash=shard.column("stash")[0].as_py())
            place = {k: i for i, k in enumerate(_split(shard.column("keys")[0].as_py()))}
            owners, none = np.frombuffer(shard.column("owners")[0].as_py(), np.int64), np.frombuffer(shard.column("unowned")[0].as_py(), np.uint8)
            for block, keys in zip(asked.column("block").to_pylist(), asked.column("asked").to_pylist(), strict=True):
                known = [keys[16 * i : 16 * i + 16] for i in np.flatnonzero(filt.holds(_halves(keys)[1])).tolist()]
                sure = [k for k in known if k in place]
                if sure:
                    at = [place[k] for k in sure]
                    for c, x in zip(out, (block, b"".join(sure), owners[at].tobytes(), none[at].tobytes()), strict=True):
                        out[c].append(x)
        return pa.table({"block": pa.array(out["block"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("keys", "owners", "unowned")}})

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        gone: dict[bytes, int | None] = {}
        for keys, owners, none in zip(*(replies.column(c).to_pylist() for c in ("keys", "owners", "unowned")), strict=True):
            ids = [None if n else i for i, n in zip(np.frombuffer(owners, np.int64).tolist(), none, strict=True)]
            gone.update(zip(_split(keys), ids, strict=True))
        n, dropped, texts_, sums = [], [], [], []
        for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text"), strict=True):
            lines = _encoded(text.as_py()).split(b"\n")
            stays = lambda x, own=doc_id: (k := line_key(x, min_chars)) not in gone or (keep_owner and gone[k] == own)
            kept = [x for x in lines if stays(x)] if gone else lines
            joined = b"\n".join(kept)
            n.append(len(lines))
            dropped.append(len(lines) - len(kept))
            texts_.append(joined.decode("utf-8", "replace"))
            sums.append(hashlib.sha256(joined).hexdigest())
        return pa.table([table.column("doc_id"), table.column("carried"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts_, pa.string()), pa.array(sums, pa.string())], ["doc_id", "carried", "n_lines", "n_dropped", "kept_text", "kept_sha256"])

    blocks = texts.groupBy("block")
    replies = blocks.applyInArrow(pack, "block int, shard int, asked binary").groupBy("shard").cogroup(filters.groupBy("shard"))
    replies = replies.applyInArrow(confirm, "block int, keys binary, owners binary, unowned binary")
    schema = texts.select("doc_id", "carried").schema.add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string").add("kept_sha256", "string")
    out = blocks.cogroup(replies.groupBy("block")).applyInArrow(finish, schema)
    return out.select("doc_id", *[F.col("carried")[c].alias(c) for c in carry], "n_lines", "n_dropped", "kept_text", "kept_sha256")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_frequent_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key
GROUP BY k.doc_id
"""
