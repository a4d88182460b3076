"""Operator 6: exact URL filtering by a cascade of Bloom filters.

A list of keys is encoded against the *universe*, every key that the corpus
can ask for. Level 1 holds the listed keys; level 2 holds the other keys of
the universe that level 1 lets through; level 3 the listed keys that level 2
lets through; and so on until a level lets nothing wrong through. The first
level that refuses a key decides, so for keys of the universe the answer is
exact, and a URL is judged by a lookup without a join. The keys are dealt into
shards by a hash, so neither a task nor the driver ever holds more than a
bounded part of a cascade, however long the lists are.

Keys here are host and path of a rule, such as ``example.net/en/``. A rule
fits its host and all subdomains if the URL's path starts with the rule's
path; the longest rule that fits wins. The keys of a URL are therefore its
host suffixes of at most as many labels as a rule has, with the path prefixes
whose length some rule has.

Null URLs and URLs without ``://`` have an empty host and path and fit no
rule. A URL that fits no rule is on no list: the cascade's verdict is allow.
Repeated rows stay; an empty table gives an empty result; columns besides
``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exchange as X
from weftline.llm import words as W

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Keys of the universe that a shard of a cascade has on average, and bytes of cascades that are broadcast at once.
SHARD_KEYS, BROADCAST_BYTES = 1 << 20, 64 << 20


def _bits_for(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64) * 64, max(1, round(-math.log2(rate)))


def _halves(key: Column) -> tuple[Column, Column]:
    """128 bits of a key, from which all its positions follow."""
    return F.xxhash64(F.lit(17), key), F.xxhash64(key, F.lit(29))


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # uint64

    def positions(self, number: int, keys: np.ndarray) -> np.ndarray:
        """(keys, hashes) of the halves of some keys."""
        own = keys[:, 0] ^ W.mix(keys[:, 1], 200 + number)
        return np.stack([W.mix(own, i) % np.uint64(self.bits) for i in range(self.hashes)], axis=1)

    def holds(self, number: int, keys: np.ndarray) -> np.ndarray:
        at = self.positions(number, keys)
        return (((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)) == 1).all(axis=1)


def levels_for(listed: np.ndarray, others: np.ndarray, rate: float) -> list[Level]:
    """Levels that tell the listed keys from the others (rows of two halves)."""
    levels: list[Level] = []
    held = listed
    while len(held):
        if len(levels) == 64 and set(map(tuple, listed.tolist())) & set(map(tuple, others.tolist())):
            raise ValueError("two keys agree in all 128 bits")
        level = Level(*_bits_for(len(held), rate), np.zeros(0, np.uint64))
        at = level.positions(len(levels), held).reshape(-1)
        bits = np.zeros(level.bits, dtype=bool)
        bits[at] = True
        level.words = np.packbits(bits, bitorder="little").view(np.uint64)
        wrong = others[level.holds(len(levels), others)] if len(others) else others
        levels.append(level)
        held, others = wrong, held
    return levels


def listed_in(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: the first level that refuses it decides."""
    out = np.zeros(len(keys), dtype=bool)
    open_ = np.arange(len(keys))
    for i, level in enumerate(levels):
        through = level.holds(i, keys[open_])
        out[open_[~through]] = i % 2 == 1
        open_ = open_[through]
    out[open_] = len(levels) % 2 == 1
    return out


def _written(levels: list[Level]) -> bytes:
    head = np.array([len(levels), *(x for v in levels for x in (v.bits, v.hashes))], dtype=np.int64)
    return head.tobytes() + b"".join(v.words.tobytes() for v in levels)


def _read(data: bytes) -> list[Level]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8).tolist(), 8 + 16 * n, []
    for bits, hashes in zip(head[::2], head[1::2], strict=True):
        out.append(Level(bits, hashes, np.frombuffer(data, np.uint64, bits // 64, at)))
        at += bits // 8
    return out


@dataclass
class Cascade:
    """rows: shard, levels (binary), for each shard that has listed keys."""

    rows: DataFrame
    shards: int

    def parts(self) -> list[list[int]]:
        """The shards in groups of at most BROADCAST_BYTES (a single one may have more)."""
        out: list[list[int]] = []
        room = 0
        for r in self.rows.select("shard", F.length("levels").alias("n")).orderBy("shard").toLocalIterator():
            if not out or r["n"] > room:
                out.append([])
                room = BROADCAST_BYTES
            out[-1].append(r["shard"])
            room -= r["n"]
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = 0.01) -> Cascade:
    """A cascade that tells the listed keys from all other keys of the universe.
    Both tables have a column ``key``; listed keys outside the universe are
    never asked for and left out. The keys are dealt into shards of bounded
    size by a hash, and a task makes all levels of its shard."""
    both = universe.select("key", F.lit(True).alias("asked"), F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(False).alias("asked"), F.lit(True).alias("listed")))
    keys = both.filter("key is not null").groupBy("key").agg(F.bool_or("asked").alias("asked"), F.bool_or("listed").alias("listed")).filter("asked")
    first, second = _halves(F.col("key"))
    keys = X.cut(keys.select(first.alias("first"), second.alias("second"), "listed"))
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        halves = np.stack([np.asarray(table.column(c)).view(np.uint64) for c in ("first", "second")], axis=1)
        yes = np.asarray(table.column("listed")).astype(bool)
        levels = levels_for(halves[yes], halves[~yes], rate)
        some = levels[:1]
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * len(some), pa.int32()), "levels": pa.array([_written(levels) for _ in some], pa.binary())})

    dealt = keys.withColumn("shard", F.pmod("first", F.lit(shards)).cast("int"))
    return Cascade(X.cut(dealt.groupBy("shard").applyInArrow(build, "shard int, levels binary")), shards)


def _lookup(rows: list[tuple[int, bytes]], shards: int, spark: SparkSession):
    """A column function of the halves of the keys in an array: whether these shards list each."""
    shared = spark.sparkContext.broadcast(dict(rows))

    @F.arrow_udf("array<boolean>")
    def lookup(first: pa.Array, second: pa.Array) -> pa.Array:
        keys = np.stack([np.asarray(x.flatten()).view(np.uint64) for x in (first, second)], axis=1)
        shard = np.asarray(first.flatten()) % shards
        out = np.zeros(len(keys), dtype=bool)
        for s in np.unique(shard).tolist():
            if s in shared.value:
                own = np.flatnonzero(shard == s)
                out[own] = listed_in(_read(shared.value[s]), keys[own])
        sizes = np.asarray(first.value_lengths().fill_null(0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out))

    return lookup


def with_listed(table: DataFrame, cascade: Cascade, keys: str, name: str) -> DataFrame:
    """table with an array of booleans: which of each row's keys (an array of
    keys of the universe) are listed. Cascades over BROADCAST_BYTES are looked
    up in turn, one group of shards after the other."""
    spark, parts = table.sparkSession, cascade.parts()
    first, second = F.transform(keys, lambda k: _halves(k)[0]), F.transform(keys, lambda k: _halves(k)[1])
    table = table.withColumn(name, F.transform(keys, lambda k: F.lit(False)))
    for part in parts:
        rows = [(r["shard"], bytes(r["levels"])) for r in cascade.rows.filter(F.col("shard").isin(part)).toLocalIterator()]
        hit = _lookup(rows, cascade.shards, spark)(first, second)
        table = table.withColumn(name, hit if len(parts) == 1 else F.zip_with(name, hit, lambda a, b: a | b))
        if len(parts) > 1:
            table = X.cut(table)  # the next group takes this one's place
    return table


def with_host_path(pages: DataFrame) -> DataFrame:
    """host and path of the URL; both empty without ``://``."""
    rest = F.when(F.col("url").contains("://"), F.expr("substr(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    pages = pages.withColumn("_rest", rest)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", host).withColumn("path", path).drop("_rest")


def _keys(labels: int, lengths: list[int]) -> Column:
    """The keys of a URL: host suffixes of up to ``labels`` labels with path prefixes of these lengths."""
    parts = F.split("host", r"\.", -1)
    suffixes = F.filter(F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")) for n in range(1, labels + 1)]), lambda x: x.isNotNull() & (x != ""))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    prefixes = F.filter(prefixes, lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def _listed(verdict: str) -> Column:
    """The keys of ``_keys`` that the verdict's cascade holds, with their lengths."""
    both = F.zip_with("_keys", f"_{verdict}", lambda k, m: F.when(m, F.struct(F.length(k).alias("n"), k.alias("k"), F.lit(verdict).alias("v"))))
    return F.filter(both, lambda x: x.isNotNull())


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], rate: float = 0.01) -> DataFrame:
    """page_id, url, host, path, rule, verdict of every row of pages."""
    spark = pages.sparkSession
    urls = with_host_path(pages.select("page_id", "url"))
    labels = max((h.count(".") + 1 for h, _, _ in rules), default=1)
    lengths = sorted({len(p) for _, p, _ in rules}) or [0]
    keyed = urls.withColumn("_keys", _keys(labels, lengths))
    universe = X.cut(keyed.select(F.explode("_keys").alias("key")).distinct())
    fits = []
    for verdict in ("block", "allow"):
        own = [(h + p,) for h, p, v in rules if v == verdict]
        if own:
            cascade = build_cascade(spark.createDataFrame(own, "key string"), universe, rate)
            keyed = with_listed(keyed, cascade, "_keys", f"_{verdict}")
            fits.append(_listed(verdict))
    best = F.array_max(F.concat(*fits)) if fits else F.lit(None).cast("struct<n:int,k:string,v:string>")
    return keyed.withColumn("_best", best).select("page_id", "url", "host", "path", F.col("_best.k").alias("rule"), F.coalesce("_best.v", F.lit("allow")).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(rh, rp, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM parts p LEFT JOIN fits f USING (page_id)
"""
