"""Operator 8: near-duplicate documents.

Sketch: fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017). In
round i < t every shingle falls into one of t bins by the round's hash; a bin
keeps its smallest value, and values of later rounds are larger. In round
t + j every shingle falls into bin j, so after 2t rounds every bin is full;
rounds stop as soon as a document's bins are. Bands of equal bins propose
documents; every proposal is settled on the whole shingle sets, so no link is
reported that isn't there, and a link at similarity 0.8 escapes the bands with
probability (1 - 0.8**6)**42, about 3 in a million (less at higher similarity).

Documents with the same set form a class; only one document of a class goes
further. Classes that share a band are compared by their sketches (four bits of
each bin): pairs whose bins agree in fewer than ``LIKELY`` of 256 places are let
go (at similarity 0.8 that is six standard deviations off), the others join
classes to clusters. So a cluster holds what is nearly alike, and clusters don't
grow together as the corpus grows. Bands that the same classes share count once.

A band with more than ``BAND_CLASSES`` classes, such as pages of one site with the
same boilerplate make, is not compared pair by pair. Its classes meet by their
rarest shingles instead: two sets at the similarity share one of the rarest fifth
of each, in one order of all shingles (prefix filter, exact). Again up to
``BAND_CLASSES`` classes that meet are compared by sketch. More than that which
hold one rare shingle in their rarest fifth are copies of one another as a rule
and join to a cluster, which is then compared exactly.

Within a cluster classes are compared exactly, by products of blocks of the
class-by-shingle matrix, in cells of bounded size; a cell returns only the links
of a spanning forest. Large clusters take two rounds: first each block with
itself and with the first block; then only the classes that aren't yet in the
cluster's main component with all blocks. No pair is left out but those that are
connected already.

Rows: ids may repeat or be null; each row is a document of its own. A text
without words (or null) has an empty set and is linked with nothing. Fewer
words than a shingle: the whole sequence is the one shingle. An empty table
gives an empty result. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exchange as X
from weftline.llm import words as W
from weftline.llm.components import connected

BINS, BANDS, BAND_BINS = 256, 42, 6
CELL_CLASSES, CELL_SHINGLES = 128, 1 << 20
#: Bins of two sketches that agree in a pair worth an exact comparison; classes of a band that are compared pair by
#: pair (more meet by their rarest shingles); members of bands, and pairs, that a task compares at once.
LIKELY, BAND_CLASSES, BAND_MEMBERS, PAIRS = 170, 512, 50_000, 1 << 15
#: Members of bands that a task compares in all at least, where there are so many.
TASK_MEMBERS = 4096


def shingle_sets(block: W.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and where each text's begin."""
    starts, ends, first = block.words()
    values = block.word_hashes(starts, ends)
    prefix = W.rolling(values, W.BASES[1])
    at = W.windows(first, size)
    doc = np.repeat(np.arange(len(block)), np.maximum(np.diff(first) - size + 1, 0))
    key = W.span_hash(prefix, W.BASES[1], at, at + size)
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < size))
    key = np.concatenate([key, W.mix(W.span_hash(prefix, W.BASES[1], first[few], first[few + 1]), 3)])
    doc = np.concatenate([doc, few])
    key = W.mix(key)
    order = np.argsort(key)
    order = order[np.argsort(doc[order], kind="stable")]
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(len(block) + 1))


def sketches(key: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The full sketch of every set (rows of texts without shingles stay unset)."""
    n = len(first) - 1
    unset = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, bins), unset)
    open_ = np.flatnonzero(np.diff(first) > 0)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    low = np.uint64((1 << 44) - 1)
    doc = np.repeat(np.arange(n), np.diff(first))
    for turn in range(2 * bins):
        if not len(open_):
            break
        h = W.mix(key, 100 + turn)
        value = (np.uint64(turn) << np.uint64(44)) | (h & low)
        place = doc * bins + ((h >> shift).astype(np.int64) if turn < bins else turn - bins)
        np.minimum.at(out.reshape(-1), place, value)
        full = (out[open_] != unset).all(axis=1)
        if full.any():
            open_ = open_[~full]
            live = np.zeros(n, dtype=bool)
            live[open_] = True
            stay = live[doc]
            key, doc = key[stay], doc[stay]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of every sketch."""
    out = np.zeros((len(sketch), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(BAND_BINS):
            part = np.ascontiguousarray(sketch[:, j : BANDS * BAND_BINS : BAND_BINS])
            out = W.mix(out * np.uint64(W.BASES[3]) + part, j)
        return W.mix(out + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(W.BASES[0]), 77)


def set_classes(key: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits that stand for each set: two sums of its mixed hashes."""
    sums = []
    for seed in (21, 22):
        total = np.zeros(len(key) + 1, dtype=np.uint64)
        np.cumsum(W.mix(key, seed), dtype=np.uint64, out=total[1:])
        sums.append(W.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)))
    return [x.tobytes() for x in np.stack(sums, axis=1)]


def _row() -> Column:
    """What tells rows apart; rows with the same id and text are as good as one."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row, n_shingles, cls (128 bits that stand for the set), bands, bins
    (four bits of each bin). docs: doc_id, row, text."""
    names, kind = ["doc_id", "row"], docs.schema["row"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole):
                key, first = shingle_sets(W.Block(batch.column("text"), lower=True), size)
                made = sketches(key, first)
                bands, low = band_keys(made), (W.mix(made, 5) & np.uint64(15)).astype(np.uint8)
                bins = low[:, ::2] << 4 | low[:, 1::2]
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(set_classes(key, first), pa.binary()), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in (bands, bins))], [*names, "n_shingles", "cls", "bands", "bins"])

    return docs.select("doc_id", "row", "text").mapInArrow(sign, f"doc_id long, row {kind}, n_shingles long, cls binary, bands binary, bins binary")


def alike(band: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place) of a forest of the likely pairs of each band; band: ascending; bins: one in each column."""
    first = np.flatnonzero(np.diff(band, prepend=band[0] - 1)) if len(band) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(band)))
    later = np.repeat(first + size, size) - np.arange(len(band)) - 1  # members of its band after each place
    upto = np.cumsum(later)
    left, right, at = [], [], 0
    while at < len(band):  # some places with all pairs they begin
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        i = np.repeat(np.arange(at, stop), later[at:stop])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[at:stop]) - later[at:stop], later[at:stop])
        good = (bins[i] == bins[j]).sum(axis=1) >= LIKELY
        left.append(i[good])
        right.append(j[good])
        at = stop
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    label = np.arange(len(band))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return np.flatnonzero(label != np.arange(len(band))), label[label != np.arange(len(band))]
        label = low


def _band_rows(classes: DataFrame) -> DataFrame:
    """band, cls: each class with each of its bands."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, np.int64) for x in batch.column("bands").to_pylist()]
            cls = batch.column("cls").take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), cls], ["band", "cls"])

    return classes.select("cls", "bands").mapInArrow(unpack, "band long, cls binary")


def _shared(rows: DataFrame) -> DataFrame:
    """band, cls, n, low of the classes of bands that several classes are in; of
    bands that the same classes are in, one. n: how many; low: the least hash."""
    own = F.xxhash64("cls")
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("low"), F.bit_xor(own).alias("all")).filter("n > 1")
    once = X.cut(shared.groupBy("n", "low", "all").agg(F.min("band").alias("band")).select("band", "n", "low"))
    return rows.join(once, "band")


def _compared(few: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of a forest of the likely pairs of each band (band, cls, n)."""
    spark = classes.sparkSession
    in_few = few.count()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-in_few // BAND_MEMBERS))

    def compare(table: pa.Table) -> pa.Table:
        band = np.asarray(table.column("band"))
        order = np.argsort(band, kind="stable")
        both = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, BINS // 2)[order]
        i, j = alike(band[order], np.concatenate([both >> 4, both & 15], axis=1))
        cls = table.column("cls").combine_chunks()
        return pa.table({"a": cls.take(pa.array(order[i])), "b": cls.take(pa.array(order[j]))})

    dealt = few.select("band", "cls").join(classes.select("cls", "bins"), "cls").withColumn("group", F.pmod(F.xxhash64("band"), F.lit(groups)))
    # written at once, from as many tasks as the members fill: the plan ends here
    return X.cut(dealt.groupBy("group").applyInArrow(compare, "a binary, b binary").coalesce(in_few // TASK_MEMBERS + 1))


def _stars(many: DataFrame) -> DataFrame:
    """Links that join the classes of each band (band, cls, low) to the one with the least hash."""
    many = many.withColumn("first", F.xxhash64("cls") == F.col("low"))
    center = many.filter("first").groupBy("band").agg(F.min("cls").alias("b"))
    return many.join(center, "band").filter("cls <> b").select(F.col("cls").alias("a"), "b")


def _band_links(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join the classes to clusters. docs: row, text."""
    members = _shared(_band_rows(classes))
    links = _compared(members.filter(F.col("n") <= BAND_CLASSES), classes)
    large = X.cut(members.filter(F.col("n") > BAND_CLASSES).select("cls").distinct())
    if not large.isEmpty():
        own = large.join(classes.select("cls", "row"), "cls").withColumnRenamed("cls", "node")
        meet = _shared(X.cut(_rare_rows(X.cut(_sets(docs, own, size).dropDuplicates(["node"])), percent)))
        links = links.unionByName(_compared(meet.filter(F.col("n") <= BAND_CLASSES), classes))
        links = links.unionByName(X.cut(_stars(meet.filter(F.col("n") > BAND_CLASSES))))
    return links


def prefix_length(n: int, percent: int) -> int:
    """Of so many of the shingles of a set of n, in one order of all shingles, two
    sets of the similarity share one at least."""
    return n - -(-percent * n // 100) + 1


def _rare_rows(sets: DataFrame, percent: int) -> DataFrame:
    """band, cls: each set (node, set) with its rarest shingles, enough of them that
    two sets of the similarity share one. What many sets share, such as the
    boilerplate of a site, is rarely among them. Shingles that no other set has
    are left out. They are counted in the sets given, packed by block."""
    spark = sets.sparkSession
    total = sets.agg(F.sum(F.octet_length("set")).alias("n")).first()["n"] or 0
    dealt, _ = X.dealt(sets, ["node", "set"], total)
    buckets = X.bucket_count(spark, total // 8)

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        held = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        return np.concatenate(held), np.array([len(x) for x in held])

    def pack(table: pa.Table) -> pa.Table:
        key, _ = keys_of(table)
        bucket, key, place = X.distinct((W.mix(key, 9) % np.uint64(buckets)).astype(np.int64), key)
        return X.packed(table.column("block")[0].as_py(), bucket, key, np.bincount(place, minlength=len(key)).astype(np.uint32))

    def count(table: pa.Table) -> pa.Table:
        keys, own = X.unpacked(table, "keys"), X.unpacked(table, "extra", np.uint32)
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.bincount(place, weights=np.concatenate(own)).astype(np.uint32)[place]
        return X.answers(table, [x.tobytes() for x in np.split(times, np.cumsum([len(k) for k in keys])[:-1])])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        key, n = keys_of(table)
        bucket, distinct, place = X.distinct((W.mix(key, 9) % np.uint64(buckets)).astype(np.int64), key)
        times = X.joined(replies, np.uint32)[place] if len(key) else np.zeros(0, np.uint32)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((key, times, doc))
        rank = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
        wanted = np.repeat(np.array([prefix_length(int(x), percent) for x in n], dtype=np.int64), n)
        some = order[(rank < wanted) & (times[order] > 1)]
        return pa.table({"band": pa.array(key[some].view(np.int64)), "cls": table.column("node").take(pa.array(doc[some]))})

    return X.by_block(dealt, pack, count, finish, "band long, cls binary")


def _linked_blocks(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Whether each set of left reaches the similarity with each of right
    (of left itself if None), by products of 0/1 matrices over shared shingles."""
    sets = left if right is None else left + right
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in (left if right is None else right)])
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    doc, place = doc[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    doc, place = doc[order], place[order]
    inter = np.zeros((len(n), len(m)), dtype=np.float64)
    width = 8192
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, [lo, lo + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[doc[a:b], place[a:b] - lo] = 1
        inter += part[: len(left)] @ (part if right is None else part[len(left) :]).T
    union = n[:, None] + m[None, :] - inter
    return 100 * inter >= percent * union


def _forest(linked: np.ndarray) -> np.ndarray:
    """Label of every node of a symmetric matrix: the smallest node it reaches."""
    label = np.arange(len(linked))
    np.fill_diagonal(linked, True)
    while True:
        low = np.where(linked, label[None, :], len(label)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """members (node, row and more) with the shingle set of each, less row. docs: row, text."""
    rest = [c for c in members.columns if c not in ("node", "row")]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows that repeat id and text are sent once by a task
        for whole in batches:
            for batch in W.slices(whole):
                key, first = shingle_sets(W.Block(batch.column("text"), lower=True), size)
                own = [key[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                good = []
                for x, y in zip(set_classes(key, first), batch.column("node").to_pylist(), strict=True):
                    good.append(x == y and y not in seen)
                    seen.add(y)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", *rest)), pa.array(own, pa.binary())], ["node", *rest, "set"]).filter(pa.array(good))

    texts = docs.select("row", "text").join(members, "row").select("text", "node", *rest)
    return texts.mapInArrow(sets, members.select("node", *rest).schema.add("set", "binary"))


def _exact_links(cells: DataFrame, percent: int) -> DataFrame:
    """Links of a spanning forest of each cell. cells: node, set, cluster, i, j,
    side; the cell i = j compares its nodes with each other, others side 0 with side 1."""

    def compare(table: pa.Table) -> pa.Table:
        held: dict[tuple[int, bytes], bytes] = dict(zip(zip(table.column("side").to_pylist(), table.column("node").to_pylist(), strict=True), table.column("set").to_pylist(), strict=True))
        order = sorted(held)
        nodes = [x[1] for x in order]
        own = [np.frombuffer(held[x], np.uint64) for x in order]
        if table.column("i")[0].as_py() == table.column("j")[0].as_py():
            linked = _linked_blocks(own, None, percent)
        else:
            cut = sum(x[0] == 0 for x in order)
            linked = np.zeros((len(order), len(order)), dtype=bool)
            if 0 < cut < len(order):
                across = _linked_blocks(own[:cut], own[cut:], percent)
                linked[:cut, cut:], linked[cut:, :cut] = across, across.T
        pairs = [(nodes[k], nodes[x]) for k, x in enumerate(_forest(linked).tolist()) if nodes[k] != nodes[x]]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    return cells.select("node", "set", "cluster", "i", "j", "side").groupBy("cluster", "i", "j").applyInArrow(compare, "a binary, b binary")


def _components(docs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """cls, doc_id (its smallest), root (one class of its group) of every class of
    ``signed``. docs: row, text."""
    some = signed.filter("n_shingles > 0")
    classes = some.groupBy("cls").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bins").alias("bins"))
    classes = X.cut(classes.select("cls", "doc_id", F.col("least.row").alias("row"), "n", "bands", "bins"))
    clusters = connected(_band_links(classes, docs, size, percent)).withColumnRenamed("root", "cluster")
    clusters = X.cut(clusters.join(classes.select(F.col("cls").alias("node"), "row", "n"), "node"))
    size_of = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("members") / CELL_CLASSES), F.ceil(F.col("total") / CELL_SHINGLES)).cast("int")
    members = clusters.join(size_of.select("cluster", blocks.alias("blocks")), "cluster")
    members = members.select("node", "cluster", "row", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    members = X.cut(_sets(docs, members, size))
    # round 1: each block with itself, and with the first
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    own, one = F.col("own"), F.lit(1)
    others = F.transform(F.when(F.col("blocks") > 1, F.sequence(one, F.col("blocks") - 1)).otherwise(F.array().cast("array<int>")), lambda j: cell(F.lit(0), j, 0))
    places = F.concat(F.array(cell(own, own, 0)), F.when(own == 0, others).otherwise(F.array(cell(F.lit(0), own, 1))))
    links = X.cut(_exact_links(members.withColumn("c", F.explode(places)).select("node", "set", "cluster", "c.*"), percent))
    # round 2: where there are three blocks or more, what isn't in the main component with all blocks
    large = members.filter("blocks > 2")
    if not large.isEmpty():
        roots = connected(links).withColumnRenamed("node", "_node")
        known = large.select("node", "cluster").join(roots, F.col("node") == F.col("_node"), "left").select("node", "cluster", F.coalesce("root", "node").alias("root"))
        known = X.cut(known)
        sizes = known.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("best"), F.sum("n").alias("all"))
        rest_blocks = F.ceil((F.col("all") - F.col("best.n")) / CELL_CLASSES).cast("int")
        main = main.select("cluster", F.col("best.root").alias("main"), rest_blocks.alias("rest")).filter("rest > 0")
        open_ = known.join(main, "cluster").select("node", "rest", (F.col("root") != F.col("main")).alias("apart"))
        open_ = large.join(open_, "node")
        left = open_.filter("apart").withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), F.col("rest")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = open_.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rest") - 1))).withColumn("j", F.col("own"))
        cells = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
        # block numbers of the left are kept apart from those of the right, so no cell is one block with itself
        links = links.unionByName(X.cut(_exact_links(cells.withColumn("i", -1 - F.col("i")), percent)))
    roots = X.cut(connected(links))
    return classes.select("cls", "doc_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable, its own
    included), kept (it has that id) of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", _row())
    signed = X.cut(_signed(docs, size))
    some = signed.filter("n_shingles > 0")
    ids = _components(docs, signed, size, percent)
    low = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(low, "root").select("cls", "component_id")
    rows = some.select("doc_id", "n_shingles", "cls").join(ids, "cls").select("doc_id", "n_shingles", "component_id")
    none = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def surplus_rows(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """row of all rows but one of each group; ``row`` tells the rows of
    docs apart, or rows that are the same share it. The one has the smallest id;
    a missing id comes last."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text")
    signed = X.cut(_signed(docs, size))
    some = signed.filter("n_shingles > 0")
    roots = _components(docs, signed, size, percent).select("cls", "root")
    best = some.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls", "row")).alias("best"))
    stay = best.join(roots, "cls").groupBy("root").agg(F.min("best").alias("best")).select("best.row")
    return some.select("row").distinct().join(stay, "row", "left_anti")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, size=4, percent=80)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id)
"""
