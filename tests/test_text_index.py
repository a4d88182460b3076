"""The stored inverted index: equal to plain BM25 whatever its history, and reading only its terms' folders."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_search import plain_bm25
from weftline.operators import keywords as kw
from weftline.operators import search
from weftline.sources.commits import OtherWriter
from weftline.sources.text_index import TextIndex

WORDS = [f"w{i}" for i in range(40)]


def texts(rng, n, start=0):
    return [(start + i, " ".join(rng.choices(WORDS, weights=range(1, 41), k=rng.randint(0, 25)))) for i in range(n)]


def best(docs, query, k):
    want = sorted(plain_bm25(docs, query).items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
    return [(i, round(s, 6)) for i, s in want]


def found(index, query, k, **more):
    return [(r["doc_id"], round(r["score"], 6)) for r in index.search(query, k, **more).collect()]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")


def test_a_history_of_changes_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(1)
    now = dict(texts(rng, 120)) | {500: None, 501: ""}
    index = TextIndex(spark, str(tmp_path / "a"), buckets=4, page_docs=8)
    index.upsert(frame(spark, list(now.items())))
    queries = [["w1", "w39", "w39"], ["w0"], ["none", "w5"], ["none"], []]

    def same():
        docs = list(now.items())
        for q in queries:
            for k in (3, 1000):
                assert found(index, q, k, first_pages=2) == best(docs, q, k), (q, k)
            assert dict(found(index, q, None)) == {i: round(s, 6) for i, s in plain_bm25(docs, q).items()}
        asked = spark.createDataFrame([(n, " ".join(q)) for n, q in enumerate(queries)], "query_id long, text string")
        got = {}
        for r in sorted(index.search_batch(asked, 4).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
        assert got == {n: x for n, q in enumerate(queries) if (x := best(docs, q, 4))}
        assert {(r["id"], r["length"]) for r in index.documents().collect()} == {(i, len((t or "").split())) for i, t in docs}

    same()
    changed = texts(rng, 30, 100)  # twenty old ids, ten new ones
    now |= dict(changed)
    index.upsert(frame(spark, changed))
    gone = [3, 4, 105, 125, 999]
    now = {i: t for i, t in now.items() if i not in gone}
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    same()
    again = texts(rng, 3, 3)  # deleted ids come back
    now |= dict(again)
    index.upsert(frame(spark, again))
    same()
    index.compact()
    assert [len(index.manifest()[1][x]) for x in ("segments", "tombstones")] == [1, 0]
    same()
    index.upsert(frame(spark, texts(rng, 5, 700)))
    now |= dict.fromkeys(range(700, 705))  # and lose their texts
    index.upsert(frame(spark, [(i, None) for i in range(700, 705)]))
    same()
    index.compact()
    same()
    kept = index.manifest()[0]
    assert index.clean_up() and index.numbers() == [kept] and not index.clean_up()
    same()


def test_only_the_terms_folders_are_read(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "a"), buckets=8)
    index.upsert(frame(spark, texts(random.Random(2), 50)))
    plan = index.blocks(["w7", "w8"])._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    assert "PartitionFilters: [bucket" in scan and "In(term, [w7,w8])" in scan
    read = index.blocks(["w7"]).select(F.input_file_name()).distinct().count()
    assert read == 1


def test_an_upsert_writes_only_its_own(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "a"), buckets=2)
    index.upsert(frame(spark, texts(random.Random(3), 2000)))
    whole = index.size("")
    index.upsert(frame(spark, [(7, "w1 w2"), (90_000, "w3")]))
    segment, tombstone = index.manifest()[1]["segments"][-1], index.manifest()[1]["tombstones"][-1]
    assert index.size(segment["name"]) + index.size(tombstone["name"]) < whole / 5


def test_two_writers(spark, tmp_path):
    """A writer that lost the race comes after the other."""
    one, two = (TextIndex(spark, str(tmp_path / "a"), buckets=2) for _ in range(2))
    one.upsert(frame(spark, [(1, "w1 w2")]))
    first = two.manifest()
    told = iter([first])
    two.manifest = lambda real=two.manifest: next(told, None) or real()
    one.upsert(frame(spark, [(2, "w1")]))
    two.upsert(frame(spark, [(3, "w1 w1"), (1, "w3")]))
    docs = [(1, "w3"), (2, "w1"), (3, "w1 w1")]
    assert found(one, ["w1", "w3"], 9) == best(docs, ["w1", "w3"], 9)
    with pytest.raises(OtherWriter):
        one.add(0, {})


def test_empty_and_text_ids(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "a"), buckets=2)
    assert found(index, ["w1"], 3) == [] and index.delete(frame(spark, [(1, "x")])) is None
    index.upsert(frame(spark, []))
    assert found(index, ["w1"], 3) == []
    named = TextIndex(spark, str(tmp_path / "b"), buckets=2)
    named.upsert(spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x")], "id string, document string"), "id", "document")
    assert [r["id"] for r in named.search(["x"], 5, "id").collect()] == ["a", "b"]


def test_pages_are_bounded(spark, monkeypatch):
    docs = frame(spark, texts(random.Random(4), 100)).coalesce(1)
    rows = kw.packed(docs, page_docs=7).collect()
    assert max(r["n"] for r in rows) == 7 and sum(r["n"] for r in rows if r["term"] is None) == 100
    for r in rows:
        assert len(r["ids"]) == r["n"] and r["max_tf"] == max(r["tf"]) and (r["term"] is None or r["min_length"] == min(r["lengths"]))


def test_many_queries_at_once(spark, monkeypatch):
    rng = random.Random(5)
    docs = texts(rng, 300)
    asked = [(i, " ".join(rng.choices(WORDS, k=6))) for i in range(200)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = {}
    for r in sorted(search.bm25_batch(frame(spark, docs), queries, 3).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
    assert got == {i: best(docs, t.split(), 3) for i, t in asked}
