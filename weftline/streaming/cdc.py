"""Change events to a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.collection import Collection, entries


def envelope(row: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("op", T.StringType()), T.StructField("before", row), T.StructField("after", row)])


def kafka(spark: SparkSession, servers: str, topic: str, group: str = "weftline-cdc") -> DataFrame:
    """A stream of (value, offset) from Kafka, from the earliest offset."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "kafka.group.id": group}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"), "offset")


def changes(raw: DataFrame, row: T.StructType, key: str = "id") -> DataFrame:
    """op, rowid, after, offset of well-formed events with a key; empty and
    malformed values and snapshot reads go. An event whose key changed becomes
    a delete of the old key and the change itself."""
    event = raw.withColumn("e", F.from_json("value", envelope(row))).filter(F.col("e.op").isin("c", "u", "d"))
    after, before = F.col(f"e.after.{key}").cast("string"), F.col(f"e.before.{key}").cast("string")
    event = event.withColumn("rowid", F.coalesce(after, before)).filter(F.col("rowid").isNotNull())
    main = F.struct(F.when(F.col("e.op") == "d", F.lit("d")).otherwise(F.lit("u")).alias("op"), F.col("rowid"), F.col("e.after").alias("after"))
    moved = (F.col("e.op") == "u") & after.isNotNull() & before.isNotNull() & (after != before)
    none = F.lit(None).cast(row)
    old = F.struct(F.lit("d").alias("op"), before.alias("rowid"), none.alias("after"))
    both = F.when(moved, F.array(old, main)).otherwise(F.array(main))
    return event.select(F.explode(both).alias("c"), "offset").select("c.*", "offset")


def latest(events: DataFrame) -> DataFrame:
    """The last change of each row id."""
    return events.groupBy("rowid").agg(F.max_by(F.struct("op", "after"), "offset").alias("c")).select("rowid", "c.op", "c.after")


def apply(collection: Collection, last: DataFrame, strategy, embed, source: str, table: str, tag: tuple[str, int] | None = None) -> None:
    """Put the last changes into the collection: deleted ids go, others are
    upserted with their documents. Only these rows are written."""
    gone = last.filter("op = 'd'").select(F.col("rowid").alias("id"))
    rows = last.filter("op = 'u' and after is not null").select("after.*")
    collection.change(entries(rows, strategy, embed, source, table), gone, tag)


def start(stream: DataFrame, collection: Collection, row: T.StructType, strategy, embed, checkpoint: str, key: str = "id", source: str = "cdc", table: str = "cdc"):
    """A streaming query that keeps the collection in step. A batch writes its own
    rows, and what has gathered is merged now and then; one that runs again after
    a failure is known by its number and changes nothing."""

    def batch(raw: DataFrame, number: int) -> None:
        last = latest(changes(raw, row, key)).persist()
        apply(collection, last, strategy, embed, source, table, (checkpoint, number))
        last.unpersist()
        collection.tidy()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
