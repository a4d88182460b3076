"""Operator 3: exact removal of repeated passages of words.

Rabin-Karp hashes of every window of ``length`` consecutive words are counted
over the corpus (``exchange``); windows that start at two or more places merge
into maximal removal intervals. A window is known by its 64-bit hash within a
bucket that is chosen by a second, independent hash.

Rows: each row is a document of its own, whatever its id. Null texts count as
no words. Fewer words than a window: nothing is removed. An empty table gives
an empty result. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exchange as X
from weftline.llm import words as W

SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, n_intervals long"


def _window_keys(block: W.Block, length: int, buckets: int):
    """First word of every text, window starts, and their bucket and key."""
    starts, ends, first = block.words()
    values = block.word_hashes(starts, ends)
    at = W.windows(first, length)
    key = W.span_hash(W.rolling(values, W.BASES[1]), W.BASES[1], at, at + length)
    other = W.mix(W.span_hash(W.rolling(W.mix(values, 5), W.BASES[2]), W.BASES[2], at, at + length))
    return first, at, (other % np.uint64(buckets)).astype(np.int64), key


def remove_repeated_passages(docs: DataFrame, length: int = 35, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space,
    null unless ``keep_text``), kept_sha256 and n_intervals (maximal runs of
    removed words) of every row of docs."""
    spark = docs.sparkSession
    total = X.text_bytes(docs)
    texts, _ = X.dealt(docs, ["doc_id", "text"], total)
    buckets = X.bucket_count(spark, total // 5)

    def pack(table: pa.Table) -> pa.Table:
        _, _, bucket, key = _window_keys(W.Block(table.column("text")), length, buckets)
        bucket, key, _ = X.distinct(bucket, key)
        return X.packed(table.column("block")[0].as_py(), bucket, key)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = W.Block(table.column("text"))
        first, at, bucket, key = _window_keys(block, length, buckets)
        bucket, key, place = X.distinct(bucket, key)
        again = np.bincount(place, minlength=len(key)) > 1
        if len(key):
            again |= X.joined_bits(replies, bucket)
        gone = W.covered(int(first[-1]), at[again[place]] if len(key) else at, length)
        out = {k: [] for k in ("n_words", "n_removed", "kept_text", "kept_sha256", "n_intervals")}
        for i in range(len(block)):
            mask = gone[first[i] : first[i + 1]]
            tokens = block.text(i).split()
            removed = int(mask.sum())
            if removed:
                tokens = list(compress(tokens, (~mask).tolist()))
            kept = b" ".join(tokens)
            out["n_words"].append(len(mask))
            out["n_removed"].append(removed)
            out["kept_text"].append(kept.decode("utf-8", "replace") if keep_text else None)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["n_intervals"].append(int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum()))
        return pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_text": pa.array(out["kept_text"], pa.string()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "n_intervals": pa.array(out["n_intervals"], pa.int64())})

    return X.by_block(texts, pack, X.repeated_bits, finish, SCHEMA)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_passages(docs, 35, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_intervals")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
marked AS (
  SELECT p.doc_id, p.i, word,
         coalesce(max(CASE WHEN a.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM pos p LEFT JOIN again a ON p.doc_id = a.doc_id AND p.i = a.i
), edges AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM marked),
sums AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept,
         count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_intervals
  FROM edges GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_intervals, 0) AS n_intervals
FROM w LEFT JOIN sums USING (doc_id)
"""
