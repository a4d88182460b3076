"""From raw documents to packed batches: language ID, line dedup, near-dedup,
decontamination, packing. Each stage takes (spark, docs, sf_dir) and works on
all that the one before it kept; all but the last return the columns of
``documents``.

All stages: an empty table gives an empty result; columns besides the five of
``documents`` are left out, whatever their names, and missing ones are null.
Ids may repeat or be missing: rows are judged by themselves, never by their id
alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, exchange, language_id, line_dedup, minhash_dedup, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts of at least this many bytes whose phrases in the best language are shorter than this are in no language,
#: unless less than this share of their bytes occurs in any sample: nothing is known of their script then.
GIBBERISH_BYTES, GIBBERISH_PHRASE, GIBBERISH_KNOWN = 200, 1.5, 0.5
MIN_DOCS = 10


def _documents(docs: DataFrame) -> DataFrame:
    """The five columns, whatever else the table has; missing ones are null."""
    kinds = dict(zip(COLUMNS, ("long", "string", "string", "string", "long"), strict=True))
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are in some language (operator 9), as they are.

    Null and empty texts and texts without a letter go, and so do long texts
    whose phrases are as short as those of gibberish; if no text is labelled,
    all texts go. Very long texts are judged whole. Repeated rows share one
    verdict."""
    docs = _documents(docs)
    learned = docs.withColumn("held_out", language_id.held_out()).filter("not held_out")
    found = language_id.identify(docs, language_id.gather_samples(learned), ["lang", "source", "n_chars", "text"])
    gibberish = (F.octet_length("text") >= GIBBERISH_BYTES) & (F.col("bytes_per_phrase") < GIBBERISH_PHRASE) & (F.col("known_bytes") >= GIBBERISH_KNOWN)
    return found.filter((F.col("lang_pred") != "und") & ~gibberish).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the rows with the smallest
    id that hold them alone (operator 5); documents that lose every line so go.

    Null and empty texts become empty ones and stay, for they lose nothing.
    Missing ids come after all others; if only rows without an id hold a line,
    it stays in them. n_chars is that of the text that is left."""
    docs = _documents(docs)
    kept = line_dedup.drop_frequent_lines(docs, MIN_DOCS, keep_owner=True, carry=["lang", "source"])
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.col("kept_text"), F.lit(" \t\n\x0b\x0c\r")) == "")
    kept = kept.filter(~emptied).select("doc_id", F.col("kept_text").alias("text"), "lang", "source")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id
    (operator 8: five words, 0.8). Rows are told apart by 128 bits of hashes of all
    five columns, and of rows that are the same in all five one stays.

    Texts without words (or null) are copies of nothing and stay. A missing id
    comes after all others; of rows with one id the one with the smallest set
    digest and row hash stays."""
    missing = [F.col(c).isNull() for c in COLUMNS]  # nulls alone don't change a hash
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *COLUMNS, *missing)), 16, "0")
    rows = _documents(docs).withColumn("row", F.unhex(F.concat(half(1), half(2))))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    apart = rows.filter(worded).dropDuplicates(["row"])
    kept = apart.join(minhash_dedup.surplus_rows(rows, size=5, percent=80), "row", "left_anti")
    return kept.unionByName(rows.filter(~worded)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go (operator 2), others stay as they are.

    Null texts and texts without words hold nothing; items that are null or
    without words are held by nothing. Repeated rows share one verdict; of a
    very long text every passage is looked at."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(_documents(docs), items)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches (operator 10).

    Null and empty texts have length 0 and are packed too, repeated rows each.
    Rows of one length may stand in any order within their bucket."""
    return packing.pack(_documents(docs))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the suffix automata of the first stage; tests/llm restates all five in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared
    folder, read again by the next, and deleted when that is written. The last
    one's stay, for the returned rows are read from them."""
    before = exchange.scratch_folders()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = stage(spark, docs, sf_dir)
        path = exchange.scratch(spark, name)
        rows.write.parquet(path)
        exchange.drop_scratch(spark, [*before, path])
        docs = spark.read.parquet(path)
    return docs
