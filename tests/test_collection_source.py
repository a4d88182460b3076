"""The collection read by name: batch, pages of ids, changes and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_rows import held, rows_of
from weftline.sources import collection as co
from weftline.sources import collection_source as cs


@pytest.fixture
def box(spark, tmp_path):
    cs.register(spark)
    box = co.Collection(spark, str(tmp_path / "c"), buckets=4)
    box.replace(rows_of(spark, *[(str(i), f"a{i}") for i in range(40)]))
    box.change(rows_of(spark, ("7", "new"), ("é", "accent")), spark.createDataFrame([("9",)], "id string"))
    box.change(rows_of(spark, ("9", "back")), spark.createDataFrame([("7",), ("8",)], "id string"))
    return box


def read(spark, box, **options):
    return spark.read.format("weftline_collection").option("path", box.folder).options(**options).load()


def test_batch_equals_the_collection(spark, box):
    rows = read(spark, box)
    assert {r["id"]: r["document"] for r in rows.collect()} == held(box)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == len(held(box))
    assert {r["id"]: r["document"] for r in read(spark, box, version=0).collect()} == {str(i): f"a{i}" for i in range(40)}
    assert rows.filter("id = '7'").count() == 0
    assert read(spark, co.Collection(spark, box.folder + "-none")).count() == 0


def test_ids_leave_their_pages_only(spark, box):
    want = {k: page for k, page in spark.createDataFrame([(str(i),) for i in range(40)] + [("é",)], "id string").select("id", F.pmod(F.xxhash64("id"), F.lit(4))).collect()}
    assert all(cs.page_of(k, 4) == page for k, page in want.items())
    one = read(spark, box).filter("id = '12'")
    assert one.rdd.getNumPartitions() == 1 and [r["document"] for r in one.collect()] == ["a12"]
    some = read(spark, box).filter(F.col("id").isin("é", "3"))
    assert some.rdd.getNumPartitions() == len({want["é"], want["3"]}) and some.count() == 2


def test_changes_come_once(spark, box, tmp_path):
    changes = sorted((r["version"], r["id"], r["document"], r["gone"]) for r in read(spark, box, changes="true", version=0).collect())
    assert changes == [(1, "7", "new", False), (1, "9", None, True), (1, "é", "accent", False), (2, "7", None, True), (2, "8", None, True), (2, "9", "back", False)]

    def run():
        stream = spark.readStream.format("weftline_collection").option("path", box.folder).option("changes", "true").load()
        query = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    box.compact()
    box.upsert(rows_of(spark, ("50", "late")))
    run()
    got = spark.read.schema(cs.CHANGES).json(str(tmp_path / "out"))
    assert got.count() == 40 + 6 + 1 and {r["version"] for r in got.filter("id = '50'").collect()} == {box.version()}
    newest = got.groupBy("id").agg(F.max_by(F.struct("document", "gone"), "version").alias("r")).filter("not r.gone")
    assert {r["id"]: r["r"]["document"] for r in newest.collect()} == held(box)
    box.clean_up()
    with pytest.raises(Exception, match="cleaned up"):
        read(spark, box, changes="true").count()
