"""Rows to texts and back, profiling, collections and change events."""

from __future__ import annotations

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.model import Settings, Strategy
from weftline.operators import profile
from weftline.plans import rag
from weftline.sources import collection as co
from weftline.sources import sinks
from weftline.sources import strategies as st
from weftline.sources import tables as ta
from weftline.streaming import cdc


def products(spark):
    rows = [(1, "Lamp", "a lamp", 9.5, "2024-01-01", "x1"), (2, "Chair", "a chair", 20.0, "2024-01-02", "x2")]
    return spark.createDataFrame(rows, "id int, product_name string, description string, price double, created_at string, password_hash string")


def test_classify_names_then_types(spark):
    s = profile.classify(products(spark))
    assert (s.rowid_col, s.id_cols, s.date_cols, s.skip_cols) == ("id", ["id"], [], ["password_hash"])
    assert (s.semantic_cols, s.numeric_cols) == (["product_name", "description", "created_at"], ["price"])
    assert s.template == "product_name: {product_name} | description: {description} | created_at: {created_at} | price: {price} | id: {id}"


@pytest.mark.parametrize("name, kind", [("user_id", None), ("country_code", None), ("created_at", None), ("id", "id"), ("_id", "id"), ("row id", "id"), ("doc-id", "id"), ("date", "date")])
def test_underscores_do_not_part_names(name, kind):
    found = "id" if profile.ID_NAME.search(name) else "date" if profile.DATE_NAME.search(name) else None
    assert found == kind


def test_booleans_take_no_part(spark):
    s = profile.classify(spark.createDataFrame([(1, True)], "id int, flag boolean"))
    assert "flag" not in s.text_cols


def test_low_cardinality_text_is_an_id(spark):
    df = spark.range(10).select("id", F.lit("x").alias("kind"), F.col("id").cast("string").alias("label"))
    s = profile.classify(df)
    assert s.semantic_cols == ["label"] and s.id_cols == ["id", "kind"]


@pytest.mark.parametrize(
    "document, expected",
    [
        ("name: A | email: | id: 3", [("name", "A"), ("email", ""), ("id", "3")]),
        ("bio: likes a | b: c | id: 2", [("bio", "likes a"), ("b", "c"), ("id", "2")]),
        ("name: A | B | id: 5", [("name", "A | B"), ("id", "5")]),
        ("url: http://x/y | id: 1", [("url", "http://x/y"), ("id", "1")]),
        ("note: time: 5 | id: 4", [("note", "time: 5"), ("id", "4")]),
        ("no pairs here", None),
    ],
)
def test_pairs(spark, document, expected):
    row = spark.createDataFrame([(document,)], "d string").select(tx.pairs(F.col("d")).alias("p")).first()["p"]
    assert (None if row is None else [(p["key"], p["value"]) for p in row]) == expected


def test_last_of_equal_keys_and_json_and_missing_id(spark):
    s = Strategy("id", "", ["name"], ["n"], ["id"])
    docs = [("7", "name: A | name: B | n: true"), ("8", '{"name": "J", "n": "1.5", "id": "80"}'), ("9", "x: y"), ("10", None), ("11", "plain")]
    out = {r["key"]: r for r in tx.parse(spark.createDataFrame(docs, "key string, document string"), s, rowid="key").collect()}
    assert (out["7"]["name"], out["7"]["n"], out["7"]["id"]) == ("B", 1.0, "7")
    assert (out["8"]["name"], out["8"]["n"], out["8"]["id"]) == ("J", 1.5, "80")
    assert out["9"]["parsed"] and out["9"]["name"] is None
    assert not out["10"]["parsed"] and not out["11"]["parsed"]


@pytest.mark.parametrize("raw, value", [("true", 1.0), ("no", 0.0), ("None", None), ("", None), ("1e3", 1000.0), ("1_000", None), ("abc", None)])
def test_numbers(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "v string").select(tx.coerce_number(F.col("v")).alias("v")).first()["v"] == value


def test_null_text_is_none_and_null_number_is_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", 1.25)], "id int, name string, price double")
    s = Strategy("id", "", ["name"], ["price"], ["id"])
    docs = df.select(F.col("id").cast("string").alias("key"), tx.serialize(df, s).alias("document"))
    assert docs.filter("key = '1'").first()["document"] == "name: None | price: None | id: 1"
    back = {r["key"]: r for r in tx.parse(docs, s, rowid="key").collect()}
    assert back["1"]["name"] == "None" and back["1"]["price"] is None and back["2"]["price"] == 1.25


def test_infer_types(spark):
    s = Strategy("id", "", ["t"], ["a", "b", "c", "d"], [])
    docs = spark.createDataFrame([("t: x | a: 1 | b: 1.5 | c: q | d: None",), ("t: y | a: 2 | b: 2 | c: 3 | d: None",)], "document string")
    assert profile.infer_types(docs, s) == {"t": "TEXT", "a": "INTEGER", "b": "REAL", "c": "TEXT", "d": "REAL"}
    schema = profile.reconcile(s, {"a": "INTEGER"}, ["zz", "__hidden", "aa"])
    assert schema.names == ["t", "a", "b", "c", "d", "aa", "zz", "__orig_rowid__"] and schema["a"].dataType == T.LongType()
    assert 'DEFAULT 5' in profile.ddl(schema, {"a": "5"})


def test_strategy_json_forms():
    s = Strategy("id", "t", ["a"], ["b"], ["id"])
    assert Strategy.from_json(s.to_json()) == s
    raw = json.dumps({"rowid_col": "id", "template": "", "semantic_cols": "a, b", "numeric_cols": '["c"]', "other": 1})
    assert Strategy.from_json(raw).semantic_cols == ["a", "b"] and Strategy.from_json(raw).numeric_cols == ["c"]


def test_settings_from_env():
    s = Settings.from_env({"WEFTLINE_TOP_K": "3", "WEFTLINE_BLOCK_INJECTIONS": "no", "WEFTLINE_BLOCKED_KEYWORDS": "a, b"})
    assert (s.top_k, s.block_injections, s.blocked_keywords) == (3, False, ("a", "b"))


def test_pages_and_export(spark):
    df = spark.createDataFrame([(i,) for i in range(25, 0, -1)], "k int")
    got = {r["k"]: r["chunk_id"] for r in ta.paged(df, "k", 10).collect()}
    assert got == {k: (k - 1) // 10 for k in range(1, 26)}
    assert (ta.pages(25, 10), ta.pages(0, 10)) == (3, 0)
    lines = [r["value"] for r in sinks.aligned_lines(spark.createDataFrame([(1, None), (100, "ab")], "n int, name string")).collect()]
    assert lines == ["1   | NULL", "100 | ab  "]
    assert list(sinks.sse(["a\nb"])) == ["data: a\\nb\n\n", "data: [DONE]\n\n"]


def test_sources_that_fail_stop_no_other(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    found, failed = ta.read_all(spark, {"good": {"kind": "parquet", "path": str(tmp_path / "t")}, "gone": {"kind": "parquet", "path": str(tmp_path / "x")}, "odd": {"kind": "xml"}})
    assert found["good"].count() == 3 and sorted(failed) == ["gone", "odd"] and "no source named xml" in failed["odd"]


def test_numbers_and_progress(spark):
    rows = sinks.numbered(spark.range(10).repartition(3), after=7).collect()
    assert len({r["__extract_id"] for r in rows}) == 10 and min(r["__extract_id"] for r in rows) == 8
    log = spark.createDataFrame([(3, 2), (9, 5)], "row_id long, rows_written long")
    assert tuple(co.progress(log).first()) == (2, 9, 7) and tuple(co.progress(log.limit(0)).first()) == (0, 0, 0)


def test_collection_versions_upsert_delete(spark, tmp_path):
    box = co.Collection(spark, str(tmp_path / "c"))
    assert box.read().count() == 0
    rows = lambda *x: spark.createDataFrame([(i, None, d, {"rowid": i}) for i, d in x], co.COLLECTION)
    box.upsert(rows(("1", "a"), ("2", "b"), ("2", "c")))
    box.upsert(rows(("2", "new"), ("3", "d")))
    assert {r["id"]: r["document"] for r in box.read().collect()} == {"1": "a", "2": "new", "3": "d"}
    pages = [box.page(p) for p in box.pages()]
    assert sorted(r["id"] for p in pages for r in p.collect()) == ["1", "2", "3"] and "embedding" not in pages[0].columns
    assert box.page("no such page", with_embedding=True).count() == 0
    box.delete(spark.createDataFrame([("1",)], "id string"))
    assert sorted(r["id"] for r in box.read().collect()) == ["2", "3"]


def rows_of(spark, *x):
    return spark.createDataFrame([(i, None, d, {"rowid": i}) for i, d in x], co.COLLECTION).coalesce(1)


def held(box):
    return {r["id"]: r["document"] for r in box.read().collect()}


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    """The first to arrive wins, a deleted id that comes again is there, and the base stays as it is."""
    box = co.Collection(spark, str(tmp_path / "c"), buckets=8)
    box.replace(rows_of(spark, *[(str(i), "a" * 500 + str(i)) for i in range(3000)]))
    base = box.manifest()[1]["layers"][0]
    box.change(rows_of(spark, ("7", "z"), ("7", "b")), spark.createDataFrame([("7",), ("4040",), ("9",)], "id string"))
    layers = box.manifest()[1]["layers"]
    assert layers[0] == base and layers[1]["bytes"] * 20 < base["bytes"]
    want = {str(i): "a" * 500 + str(i) for i in range(3000) if i != 9} | {"7": "z"}
    assert held(box) == want
    box.upsert(rows_of(spark, ("9", "back")))
    assert held(box) == want | {"9": "back"}
    assert {i for p in box.pages() for i in (r["id"] for r in box.page(p).collect())} == set(want) | {"9"} and len(box.pages()) == 8
    assert {r["id"]: r["document"] for r in box.read(0).collect()}["9"].startswith("a")  # the first version
    plan = box.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [id" in plan and "LeftAnti" in plan  # the base isn't moved


def test_deltas_are_merged_and_buckets_split(spark, tmp_path):
    box = co.Collection(spark, str(tmp_path / "c"), buckets=2, bucket_bytes=2_000)
    want = {}
    for k in range(12):
        new = {str(i): f"{k}/{i}" for i in range(k, 40, 3)}
        gone = [str(i) for i in range(k, 40, 7)] if k % 2 else []
        want = {i: d for i, d in want.items() if i not in gone} | new
        box.change(rows_of(spark, *new.items()), spark.createDataFrame([(i,) for i in gone], "id string"))
        box.tidy()
        assert held(box) == want
    layers = box.manifest()[1]["layers"]
    assert len(layers) <= co.DELTAS + 1
    box.compact()
    assert held(box) == want and [x["kind"] for x in box.manifest()[1]["layers"]] == ["base"] and box.manifest()[1]["layers"][0]["buckets"] > 2
    newest = box.version()
    assert box.clean_up() and box.numbers() == [newest] and held(box) == want
    assert sum(n.startswith("v-") for n in box.names()) == 1


def test_writers(spark, tmp_path):
    """Changes of different ids both succeed, of the same id the second fails; a merge in between is no conflict."""
    box = co.Collection(spark, str(tmp_path / "c"), buckets=2)
    box.replace(rows_of(spark, *[(str(i), "a") for i in range(20)]))

    def stale(version):
        other = co.Collection(spark, str(tmp_path / "c"), buckets=2)
        told, real = iter([(version, other.content(version))]), other.manifest
        other.manifest = lambda v=None: real(v) if v is not None else next(told, None) or real()
        return other

    before = box.version()
    box.upsert(rows_of(spark, ("1", "mine")))
    box.compact()
    stale(before).upsert(rows_of(spark, ("2", "theirs")))
    assert (held(box)["1"], held(box)["2"]) == ("mine", "theirs")
    with pytest.raises(co.OtherWriter):
        stale(before).upsert(rows_of(spark, ("1", "late")))
    now = box.version()
    box.replace(rows_of(spark, ("3", "all")))
    with pytest.raises(co.OtherWriter):
        stale(now).delete(spark.createDataFrame([("5",)], "id string"))
    assert held(box) == {"3": "all"}


def test_a_change_with_a_known_number_is_not_made_again(spark, tmp_path):
    box = co.Collection(spark, str(tmp_path / "c"), buckets=2)
    box.change(rows_of(spark, ("1", "a")), tag=("stream", 4))
    box.change(rows_of(spark, ("1", "b")), tag=("stream", 4))
    assert held(box) == {"1": "a"}
    box.change(rows_of(spark, ("1", "c")), tag=("other", 4))
    assert held(box) == {"1": "c"}


def test_chunks_move_fail_and_are_reset(spark):
    log = spark.createDataFrame([(0, "running", 1, None), (0, "done", 2, None), (1, "running", 1, None), (1, "failed", 3, "boom"), (2, "running", 4, None), (3, "running", 1, None), (3, "failed", 2, "x"), (3, "running", 3, None), (3, "failed", 4, "y")], "chunk_id long, status string, at long, error string")
    assert sorted((r["chunk_id"], r["attempts"], r["error"]) for r in co.failed_chunks(log).collect()) == [(1, 1, "boom"), (3, 2, "y")]
    assert [r["chunk_id"] for r in co.to_retry(log, 2).collect()] == [1]
    assert [tuple(r) for r in co.reset(log, F.lit(9)).collect()] == [(2, "pending", 9, None)]
    some = spark.range(5).withColumnRenamed("id", "chunk_id")
    assert sorted(r["chunk_id"] for r in co.moved(log, some, "running", F.lit(9)).collect()) == [1, 3, 4]
    assert sorted(r["chunk_id"] for r in co.moved(log, some, "done", F.lit(9)).collect()) == [2]


def test_newest_strategy(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert st.newest(spark, folder) is None
    with pytest.raises(st.NoStrategy):
        st.load(spark, folder, "a")
    st.save(spark, folder, Strategy("id", "old"), "a", 1.0)
    st.save(spark, folder, Strategy("id", "new"), "a", 2.0)
    st.save(spark, folder, Strategy("id", "other"), "b", 3.0)
    assert (st.load(spark, folder, "a").template, st.load(spark, folder).template) == ("new", "other")


def test_row_texts_lose_nothing(spark):
    values = [0.001, 1234.56789, 1e300, -0.1, float("nan"), float("inf"), 1e-7, None]
    df = spark.createDataFrame([(i, v, f"n{i}", datetime(2024, 1, 2, 3, 4, 5, 678 if i else 0)) for i, v in enumerate(values)], "id int, price double, name string, created timestamp")
    strategy = Strategy("id", "", ["name"], ["price"], ["id"], ["created"])
    texts = df.select(F.col("id").cast("string").alias("id"), tx.serialize(df, strategy).alias("document"))
    got = {r["id"]: (str(r["price"]), r["created"]) for r in tx.parse(texts, strategy, kinds={"created": "timestamp", "id": "int"}, with_dates=True).collect()}
    assert got == {r["id"]: (str(r["price"]), r["created"]) for r in df.collect()}


def test_resume_keeps_zero_and_drops_null(spark):
    rows = spark.createDataFrame([(0,), (1,), (None,), (2,)], "id int")
    done = spark.createDataFrame([("1",)], "row_id string")
    assert sorted(r["id"] for r in co.unprocessed(rows, done, "id").collect()) == [0, 2]


def test_forward_then_reverse(spark):
    df = spark.createDataFrame([(i, f"name {i}", i * 1.5) for i in range(20)], "id int, name string, price double")
    empty = spark.createDataFrame([], co.COLLECTION)
    stored, strategy = rag.forward(df, empty, spark.createDataFrame([("3",)], "row_id string"))
    assert stored.count() == 19
    back = rag.reverse(stored, strategy)
    got = {r["__orig_rowid__"]: (r["name"], r["price"], r["id"]) for r in back.collect()}
    assert got == {str(i): (f"name {i}", i * 1.5, str(i)) for i in range(20) if i != 3}
    assert rag.reverse(stored, strategy, target=back.filter("id <> '5'")).count() == 1


def test_drift_columns_come_back_typed(spark):
    strategy = Strategy("id", "", ["name"], ["price"], ["id"])
    docs = [("1", "name: a | price: 2 | id: 1"), ("2", '{"name": "b", "price": 3, "id": 2, "size": 4, "tag": "x", "ratio": 1.5}'), ("3", "name: c | price: 5 | id: 3 | colour: red | size: 7"), ("4", None), ("5", "no pairs"), ("6", '{"size": 9, "ratio": 2}')]
    stored = spark.createDataFrame(docs, "id string, document string")
    assert profile.drift(stored, strategy) == ["colour", "ratio", "size", "tag"] and profile.drift(stored.limit(0), strategy) == []
    assert {r["column"]: r["documents"] for r in profile.seen_columns(stored).collect()} == {"name": 3, "price": 3, "id": 3, "size": 3, "tag": 1, "ratio": 2, "colour": 1}
    back = rag.reverse(stored, strategy)
    assert back.columns == ["name", "price", "id", "colour", "ratio", "size", "tag", "__orig_rowid__"]
    got = {r["__orig_rowid__"]: (r["colour"], r["size"], r["ratio"]) for r in back.collect()}
    assert got == {"1": (None, None, None), "2": (None, 4, 1.5), "3": ("red", 7, None), "6": (None, 9, 2.0)}
    assert rag.reverse(stored, strategy, drift=False).columns == ["name", "price", "id", "__orig_rowid__"]
    assert profile.json_types(stored.limit(1)) == {}


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def events(spark, *rows):
    return spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r, i) for i, r in enumerate(rows)], "value string, offset long")


def test_cdc_latest_delete_zero_key_and_moved_key(spark):
    raw = events(
        spark,
        {"op": "c", "after": {"id": 0, "name": "zero"}},
        {"op": "c", "after": {"id": 1, "name": "a"}},
        {"op": "u", "before": {"id": 1, "name": "a"}, "after": {"id": 5, "name": "moved"}},
        {"op": "d", "before": {"id": 9, "name": "never there"}},
        {"op": "r", "after": {"id": 7, "name": "snapshot"}},
        "not json",
        None,
        {"op": "c", "after": {"name": "no key"}},
    )
    last = {r["rowid"]: (r["op"], r["after"] and r["after"]["name"]) for r in cdc.latest(cdc.changes(raw, ROW)).collect()}
    assert last == {"0": ("u", "zero"), "1": ("d", None), "5": ("u", "moved"), "9": ("d", None)}


def test_cdc_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    box = co.Collection(spark, str(tmp_path / "c"))
    strategy = Strategy("id", "", ["name"], [], ["id"])

    def run():
        stream = spark.readStream.schema("value string, offset long").json(str(source))
        query = cdc.start(stream, box, ROW, strategy, vx.embedder(), str(tmp_path / "ckpt"))
        query.processAllAvailable()
        query.stop()

    write = lambda name, rows: (source / name).write_text("\n".join(json.dumps({"value": json.dumps(v), "offset": o}) for o, v in rows))
    write("a.json", [(1, {"op": "c", "after": {"id": 1, "name": "x"}}), (2, {"op": "c", "after": {"id": 2, "name": "y"}})])
    run()
    write("b.json", [(3, {"op": "d", "before": {"id": 1}}), (4, {"op": "u", "after": {"id": 2, "name": "z"}})])
    run()
    assert {r["id"]: r["document"] for r in box.read().collect()} == {"2": "name: z | id: 2"}
    before = box.size("")
    write("c.json", [(5, {"op": "c", "after": {"id": 3, "name": "w"}})])
    run()
    assert box.size("") - before < 10_000 and box.read().count() == 2  # a batch writes its rows
    assert len(box.read().first()["embedding"]) == 64


def test_kv_pattern_is_whole():
    assert re.compile(tx.KV_PATTERN.replace("(?sU)", "(?s)"))


def test_constraints_and_jdbc_options(spark):
    columns = spark.createDataFrame([("t", "a", 1, "int", "NO", None), ("t", "b", 2, "text", "YES", "x"), ("t", "c", 3, "text", "YES", None), ("u", "a", 1, "int", "NO", None)], "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string")
    kinds = spark.createDataFrame([("k", "t", "PRIMARY KEY"), ("f", "t", "FOREIGN KEY"), ("k", "u", "UNIQUE")], "constraint_name string, table_name string, constraint_type string")
    usage = spark.createDataFrame([("k", "t", "a"), ("k", "t", "b"), ("f", "t", "c")], "constraint_name string, table_name string, column_name string")
    got = [(r["column_name"], r["is_nullable"], r["column_default"], r["is_unique"]) for r in ta.column_constraints(columns, kinds, usage, "t").collect()]
    assert got == [("a", False, None, True), ("b", True, "x", True), ("c", True, None, False)]
    assert ta.jdbc_options({"DB_NAME": "d"})["url"] == "jdbc:postgresql://localhost:5432/d"
    with pytest.raises(ValueError):
        ta.read(spark, "xlsx", "x")
