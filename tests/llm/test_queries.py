"""The numbered queries on the smallest tables: against their SQL where there is
one, else against their inputs' ids; held-out accuracy of the models."""

from __future__ import annotations

import os
import zlib
from pathlib import Path

import pytest

from weftline.llm import queries as Q

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def larger():
    """The second smallest tables, with crc32 for SQL."""
    import duckdb

    con = duckdb.connect()
    con.create_function("crc32", lambda x: zlib.crc32(x.encode()), ["VARCHAR"], "BIGINT")
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{LARGER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    result = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(map(str, (r[names.index(c)] for c in got.columns))) for r in result.fetchall())
    assert sorted(tuple(map(str, r)) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql()) - {"op2_decontaminate", "op12_whitening"}))
def test_query_returns_every_document_once(spark, name):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in Q.queries()[name](spark, SF).select("doc_id").collect()) == ids


def test_whole_items_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in Q.queries()["op2_decontaminate"](spark, SF).collect()}
    assert want and want <= got


def test_held_out_languages(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    held = [r for r in Q.queries()["op9_language_id"](spark, LARGER).collect() if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held)
    print(right)
    assert right >= 0.97


def test_held_out_texts_are_likelier_than_uniform_bytes(spark):
    rows = [r for r in Q.queries()["op7_lm_score"](spark, SF).collect() if r["held_out"]]
    assert sum(r["bits_per_byte"] for r in rows) / len(rows) < 3.5


#: Every pair of document and item with enough shingles in common, without any search before.
ALL_LEAKS = r"""
WITH fold AS (SELECT 'D' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'I', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM fold),
sides AS (
  SELECT id, 'q' AS side, ws[1:len(ws) - greatest(1, len(ws) // 4)] AS ws FROM w WHERE kind = 'I' AND len(ws) > 1
  UNION ALL SELECT id, 'a', ws[len(ws) - greatest(1, len(ws) // 4) + 1:len(ws)] FROM w WHERE kind = 'I' AND len(ws) > 0
), s AS (
  SELECT DISTINCT id, side, least(5, len(ws)) AS k, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS s
  FROM (SELECT id, side, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM sides)
), d AS (
  SELECT DISTINCT id, k, array_to_string(ws[i:i + k - 1], ' ') AS s
  FROM (SELECT id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM s) WHERE kind = 'D')
), n AS (SELECT id, side, count(*) AS n FROM s GROUP BY ALL),
share AS (SELECT d.id AS doc_id, s.id AS item_id, side, count(*) AS hits FROM s JOIN d USING (k, s) GROUP BY ALL),
held AS (SELECT doc_id, item_id, hits / n AS share FROM share JOIN n ON item_id = n.id AND share.side = n.side)
SELECT doc_id, item_id FROM held JOIN (SELECT id, count(*) AS sides FROM n GROUP BY id) c ON item_id = c.id
GROUP BY doc_id, item_id, sides HAVING count_if(share >= 0.8) = sides
"""


def test_leaks_are_those_of_all_pairs(spark, larger):
    want = set(larger.execute(ALL_LEAKS).fetchall())
    assert want
    assert {(r["doc_id"], r["item_id"]) for r in Q.queries()["op2_decontaminate"](spark, LARGER).collect()} == want


BASE = r"""
WITH t AS (
  SELECT doc_id, crc32(CAST(doc_id AS VARCHAR)) % 7 = 2 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS ws FROM documents
), w AS (SELECT doc_id, held_out, unnest(ws) AS word FROM t),
c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
FROM w LEFT JOIN c USING (word), n GROUP BY doc_id, held_out ORDER BY doc_id
"""


def test_counts_and_base_scores(spark, larger):
    want = larger.execute(BASE).fetchall()
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    got = sorted(tuple(r) for r in Q.queries()["op7_lm_score"](spark, LARGER).select(*cols).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


def test_folds_and_texts_without_letters(spark, larger):
    want = larger.execute(r"SELECT doc_id, crc32(CAST(doc_id AS VARCHAR)) % 3 = 1, NOT regexp_matches(coalesce(text, ''), '\p{L}') FROM documents ORDER BY doc_id").fetchall()
    learned = {r[0] for r in larger.execute("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL AND crc32(CAST(doc_id AS VARCHAR)) % 3 <> 1").fetchall()}
    rows = Q.queries()["op9_language_id"](spark, LARGER).collect()
    assert sorted((r["doc_id"], r["held_out"], r["lang_pred"] == "und") for r in rows) == want
    assert {r["lang_pred"] for r in rows} <= learned | {"und"} and all(0 <= r["score"] <= 1 for r in rows)
