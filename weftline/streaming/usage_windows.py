"""Usage of query events over a stream: hourly volume, sessions, errors, by event time.

The same figures of a finished table are in ``operators.usage`` and
``operators.state``; totals agree for the same events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.model import QUERY_EVENT

LATE = "1 hour"


def traced(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of query events that ``sinks.trace`` appends to a folder as JSON lines."""
    return spark.readStream.schema(QUERY_EVENT).json(folder).filter("ts is not null")


def hourly(events: DataFrame, late: str = LATE) -> DataFrame:
    """hour, queries, errors, cache_hits, mean_latency_ms of each hour; in update
    mode an hour comes again when it changed, and is forgotten when events for it
    would be too late."""
    hours = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"))
    mean = F.avg("latency_ms").alias("mean_latency_ms")
    out = hours.agg(F.count(F.lit(1)).alias("queries"), F.count("error").alias("errors"), F.count_if(F.coalesce("cache_hit", F.lit(False))).alias("cache_hits"), mean)
    return out.select(F.col("w.start").alias("hour"), "queries", "errors", "cache_hits", "mean_latency_ms")


def sessions(events: DataFrame, gap_s: int = 3600, late: str = LATE) -> DataFrame:
    """session_id, started, ended, events of each run of a session's events that no
    gap of more than ``gap_s`` parts; a run comes out when it can't grow any more."""
    gap = f"{gap_s} seconds 1 microsecond"  # Spark parts at a gap of this length already
    runs = events.filter("session_id is not null").withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return runs.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events")).drop("w")


def error_log(events: DataFrame) -> DataFrame:
    """The failed events as they come."""
    return events.filter("error is not null").select("ts", "session_id", "query", "error")


def keep_newest(stream: DataFrame, folder: str, checkpoint: str, key: str = "hour"):
    """A streaming query whose updates are appended as batches to a folder; ``newest`` reads the last of each key."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").json(f"{folder}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def newest(spark: SparkSession, folder: str, schema: str, key: str = "hour") -> DataFrame:
    """The last state of each key of what ``keep_newest`` wrote."""
    rows = spark.read.schema(f"{schema}, _batch long").json(folder)
    names = [c for c in rows.columns if c not in (key, "_batch", "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "_batch").alias("r")).select(key, "r.*")
