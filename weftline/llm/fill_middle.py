"""Operator 13: fill-in-the-middle transformation.

A text is a sequence of units, runs of ASCII letters or single other code
points. One fullmatch of the repeated unit keeps every repetition, so the ends
of the group give the number of units and both cuts at once; hashes of the
document's id choose cuts and form.

Texts: null is the empty text. Texts longer than ``PIECE`` code points are
matched in pieces that end where a unit ends, so a match holds a bounded number
of repetitions (a run of letters is never cut, however long); units are those
of the whole text. A null id hashes the empty string in its place. Rows are
judged by themselves: repeated ids and rows each give a row. An empty table
gives an empty result. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import words as W

#: Code points that one match takes at most, but for a run of letters.
PIECE = 1 << 20
#: The repeated unit; possessive, for the first way to match is the only one.
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
OTHER = regex.compile(r"[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts without marks so many stay plain, and of a hundred others so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
FIELDS = "n long, form string, prefix string, middle string, suffix string, output string, restored string"


def unit_ends(text: str) -> np.ndarray:
    """Where each unit of the text ends, in code points."""
    if not text:
        return np.zeros(0, np.int64)
    if len(text) <= PIECE:
        return np.array(UNITS.fullmatch(text).ends(1), dtype=np.int64)
    parts, at = [], 0
    while at < len(text):
        stop = OTHER.search(text, min(at + PIECE, len(text)))  # before a code point that is no letter a unit always ends
        upto = stop.start() if stop else len(text)
        parts.append(np.array(UNITS.fullmatch(text, at, upto).ends(1), dtype=np.int64))
        at = upto
    return np.concatenate(parts)


def draws(doc_id: int | None) -> tuple[int, ...]:
    """The four numbers that decide for a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transformed(doc_id: int | None, text: str) -> tuple[int, str, str, str, str, str]:
    """n, form, prefix, middle, suffix and output of one text (a plain one is all prefix)."""
    ends = unit_ends(text)
    n = len(ends)
    one, two, form, order = draws(doc_id)
    if not text or any(m in text for m in MARKS) or form % 100 >= 100 - PLAIN:
        return n, "plain", text, "", "", text
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if order % 100 < SUFFIX_FIRST:
        return n, "spm", prefix, middle, suffix, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", prefix, middle, suffix, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that gave the output. The marks stand in no part of it, and none
    can arise where a part meets a mark, for a mark begins at its only ``<``."""
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = rest.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = rest.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix, middle, suffix, output
    and restored (the text rebuilt from output and form) of every row. A plain
    text has null parts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "form", "prefix", "middle", "suffix", "output", "restored"]
        for whole in batches:
            for batch in W.slices(whole):
                ids = batch.column("doc_id")
                made = [transformed(i, t or "") for i, t in zip(ids.to_pylist(), batch.column("text").to_pylist(), strict=True)]
                rows = [(n, form, *((None,) * 3 if form == "plain" else (a, b, c)), out, restored(out, form)) for n, form, a, b, c, out in made]
                columns = [pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.string()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, f"doc_id long, {FIELDS}")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest("output"), digest("restored"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS g FROM d
), p AS (
  SELECT doc_id, t, u, n, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 90 THEN 'plain'
              WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c
), s AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM p
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""
