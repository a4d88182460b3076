"""Operator 9: language identification by cross-parsing.

Each language is known by a bounded sample of its labelled texts, turned into
a suffix automaton. A text is parsed greedily into the longest pieces that
occur in a language's sample. A phrase costs the logarithm of the places it can
point to: the sample's bytes and the 256 byte values; so the phrases of a small
sample, shorter for its size alone, count less. The lower the cost, the closer
the language. Phrases start afresh at every 1,024 bytes of a text, so that very
long texts are parsed side by side; every byte of every text takes part.

The automata know every byte value of their samples. Their transitions lie
interleaved in one table, walked for thousands of stretches of text at once.

Rows: each row is judged by its text alone. Null texts and texts without a
letter get ``und`` with score 0; so does everything if no labelled text was
given. Equal languages: the smaller name wins. An empty table gives an empty
result. Columns besides ``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import words as W

#: Bytes of sample per language, texts it is first sought in, and languages from which the samples get shorter:
#: the bounds of what the driver gathers.
SAMPLE_BYTES, SAMPLE_TEXTS, FULL_LANGUAGES = 40_000, 120, 200
STRETCH = 1024


def automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of every state of the suffix automaton of data; state 1 is the start, 0 none."""
    limit = 2 * len(data) + 4
    link, size, step = [0] * limit, [0] * limit, [{} for _ in range(limit)]
    last, top = 1, 1
    for c in data:
        top += 1
        new = top
        size[new] = size[last] + 1
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                top += 1
                size[top], step[top], link[top] = size[p] + 1, dict(step[q]), link[q]
                while p and step[p].get(c) == q:
                    step[p][c] = top
                    p = link[p]
                link[q] = link[new] = top
        last = new
    return step[: top + 1]


def comb(step: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The states' new numbers and a table that holds the transition of state
    s by byte c at s + c, as s << 32 | target (-1: none). Numbers are dealt so
    that no two transitions meet: 8 bytes each, whatever the alphabet."""
    number = np.zeros(len(step), dtype=np.int64)
    slot, free = np.ones(4 * len(step) + 1024, dtype=bool), np.ones(4 * len(step) + 1024, dtype=bool)
    at, width, window = 1, -1, 256
    for s in sorted(range(1, len(step)), key=lambda s: -len(step[s])):
        if len(step[s]) != width:
            at, width = 1, len(step[s])
        while True:
            if at + window + 256 > len(slot):
                slot, free = (np.concatenate([x, np.ones(len(x), dtype=bool)]) for x in (slot, free))
            fits = free[at : at + window].copy()
            for c in step[s]:
                fits &= slot[at + c : at + c + window]
            k = int(fits.argmax())
            if fits[k]:
                break
            at += window
        number[s] = at + k
        free[at + k] = False
        for c in step[s]:
            slot[at + k + c] = False
    source = np.repeat(number, [len(x) for x in step])
    byte = np.array([c for x in step for c in x], dtype=np.int64)
    target = number[np.array([t for x in step for t in x.values()], dtype=np.int64)]
    table = np.full(int(number.max()) + 256, -1, dtype=np.int64)
    table[source + byte] = source << 32 | target
    return number, table


class Model:
    """Automata of all languages, one after the other in a single table."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        self.cost = np.log([len(samples[name]) + 256 for name in self.names])  # of a phrase
        self.known = np.zeros(256, dtype=bool)  # bytes that some sample holds
        tables, self.first, at = [], [], 0
        for name in self.names:
            step = automaton(samples[name])
            number, table = comb(step)
            tables.append(np.where(table < 0, -1, table + (at << 32) + at))
            first = np.zeros(256, dtype=np.int64)  # from the start, by byte
            for c, t in step[1].items():
                first[c] = number[t] + at
            self.first.append(first)
            self.known |= first > 0
            at += len(table)
        self.table = np.concatenate(tables) if tables else np.full(256, -1, dtype=np.int64)

    def phrases(self, block: W.Block) -> np.ndarray:
        """Phrases of every text (rows) in every language (columns)."""
        n, k = len(block), len(self.names)
        size = np.diff(block.offsets)
        count = -(-size // STRETCH)
        doc = np.repeat(np.arange(n), count)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        begin = block.offsets[doc] + inner * STRETCH
        length = np.minimum(size[doc] - inner * STRETCH, STRETCH)
        order = np.argsort(-length, kind="stable")
        doc, begin, length = doc[order], begin[order], length[order]
        out = np.zeros((k, n), dtype=np.int64)
        if not len(doc):
            return out.T
        live = np.searchsorted(-length, -np.arange(1, STRETCH + 1), side="right")  # stretches with more than j bytes
        for lang, first in enumerate(self.first):
            state = np.zeros(len(doc), dtype=np.int64)  # 0: no phrase goes on from here
            phrases = np.zeros(len(doc), dtype=np.int64)
            for j in range(int(length[0])):
                m = int(live[j])
                c = block.data[begin[:m] + j]
                found = self.table[state[:m] + c]
                stuck = found >> 32 != state[:m]
                nxt = found & 0xFFFFFFFF
                if stuck.any():
                    phrases[:m] += stuck
                    nxt[stuck] = first[c[stuck]]  # a byte that the sample lacks is a phrase of its own
                state[:m] = nxt
            out[lang] = np.bincount(doc, weights=phrases, minlength=n).astype(np.int64)
        return out.T


_MODELS: dict = {}


def _model(key: str, shared) -> Model:
    """One model per worker process."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(shared.value)
    return _MODELS[key]


def gather_samples(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """A bounded sample of each language: its texts in the order of a hash,
    those of at most a tenth of ``sample_bytes`` first. Of a longer text a
    stretch of a tenth of the sample is taken, from a place that a hash of the
    text chooses, so a language of long texts is learned too.
    Where ``sample_texts`` texts don't fill the sample, more are taken."""
    kept = labelled.filter("lang is not null and text is not null and text <> ''").select("lang", "text")
    languages = labelled.select("lang").distinct().count()
    sample_bytes = max(100, min(sample_bytes, sample_bytes * FULL_LANGUAGES // max(languages, 1)))
    piece = sample_bytes // 10
    by_hash = Window.partitionBy("lang").orderBy(F.octet_length("text") > piece, F.xxhash64("text"), "text")
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - piece, F.lit(0)) + 1) + 1
    stretch = F.substr("text", place.cast("int"), F.lit(piece)).alias("text")
    samples: dict[str, bytes] = {}
    while True:
        few = kept.withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= sample_texts)
        found: dict[str, bytearray] = {}
        more = set()  # languages that have as many texts
        for row in few.select("lang", "rank", stretch).orderBy("lang", "rank").toLocalIterator():
            own = found.setdefault(row["lang"], bytearray())
            data = row["text"].encode("utf-8", "replace")[:piece]
            if len(own) + len(data) + 1 <= sample_bytes:
                own += data + b"\n"
            if row["rank"] == sample_texts:
                more.add(row["lang"])
        samples |= {k: bytes(v) for k, v in found.items() if v}
        short = sorted(k for k in more if len(found[k]) < sample_bytes - piece)
        if not short:
            return samples
        sample_texts *= 8  # each text fills two bytes at least, so this ends
        kept = kept.filter(F.col("lang").isin(short))


def identify(docs: DataFrame, samples: dict[str, bytes], carry: list[str] | None = None) -> DataFrame:
    """doc_id, the carried columns, lang_pred, score, bytes_per_phrase, known_bytes.

    score: 1 - cost in the best language / cost in the second best (1 with a
    single language); bytes_per_phrase: of the best language;
    known_bytes: share of the text's bytes that occur in any sample."""
    carry = carry or []
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    names = ["doc_id", *carry]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, shared)
        for whole in batches:
            for batch in W.slices(whole, "_text", 4 << 20):
                block = W.Block(batch.column("_text"))
                letter = np.asarray(batch.column("_letter").to_numpy(zero_copy_only=False), dtype=bool)
                lang, score, rate, known = ["und"] * len(block), np.zeros(len(block)), np.zeros(len(block)), np.zeros(len(block))
                if model.names:
                    phrases = model.phrases(block).astype(np.float64)
                    cost = phrases * model.cost
                    order = np.argsort(cost, axis=1, kind="stable")
                    rows = np.arange(len(block))
                    best = cost[rows, order[:, 0]]
                    second = cost[rows, order[:, 1]] if len(model.names) > 1 else np.full(len(block), np.inf)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = np.where(letter, 1 - best / second, 0.0)
                        rate = np.where(letter, np.diff(block.offsets) / phrases[rows, order[:, 0]], 0.0)
                    upto = np.concatenate([[0], np.cumsum(model.known[block.data])])
                    known = np.diff(upto[block.offsets]) / np.maximum(np.diff(block.offsets), 1)
                    lang = [model.names[i] if ok else "und" for i, ok in zip(order[:, 0].tolist(), letter.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64()), pa.array(known, pa.float64())], [*names, "lang_pred", "score", "bytes_per_phrase", "known_bytes"])

    schema = cols.select(*names).schema.add("lang_pred", "string").add("score", "double").add("bytes_per_phrase", "double").add("known_bytes", "double")
    return cols.mapInArrow(predict, schema)


def held_out() -> Column:
    """The fold that is not learned from; a null id belongs to none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out())
    samples = gather_samples(docs.filter("not held_out"))
    return identify(docs, samples, ["held_out"]).select("doc_id", "held_out", "lang_pred", "score", "bytes_per_phrase")
