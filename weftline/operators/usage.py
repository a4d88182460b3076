"""Usage analytics over query events (QUERY_EVENT columns; ``ts`` a timestamp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since(events: DataFrame, as_of: Column, hours: float) -> DataFrame:
    return events.filter(F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(hours * 3600)))


def record(event: DataFrame) -> DataFrame:
    """An event as it is stored: the query cut to 500 characters, and whether it was slow (over 10 s)."""
    return event.withColumn("query", F.substring("query", 1, 500)).withColumn("slow", F.col("latency_ms") > 10_000)


def summary(events: DataFrame, hours: int = 24) -> DataFrame:
    """One row; with no events only period and total."""
    n = F.count(F.lit(1))
    errors = F.count_if(F.col("error").isNotNull())
    hits = F.count_if("cache_hit")
    some = lambda c: F.when(n > 0, c)
    return events.agg(
        F.lit(hours).alias("period_hours"),
        n.alias("total_queries"),
        some(F.round(hits / F.nullif(n, F.lit(0)), 3)).alias("cache_hit_rate"),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"),
        F.round(F.max("latency_ms"), 1).alias("max_latency_ms"),
        F.round(F.avg("retrieved_rows"), 1).alias("avg_retrieved_rows"),
        some(F.round(errors / F.nullif(n, F.lit(0)), 3)).alias("error_rate"),
        some(errors).alias("errors"),
    )


def p95_latency(events: DataFrame, bins: int = 1024, most: int = 100_000) -> DataFrame:
    """Nearest rank by truncation among uncached events with a finite latency:
    the value at place min(int(0.95 n), n - 1) from 0; no events: 0. Counts in
    ``bins`` ranges tell which range holds the place, and so on within it until
    it has ``most`` events at most or a single value; only that range is sorted."""
    x = F.col("latency_ms").cast("double")
    own = events.filter(~F.col("cache_hit") & F.coalesce(F.abs(x) < float("inf"), F.lit(False))).select(x.alias("x"))
    n, low, high = own.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return events.agg(F.lit(0.0).alias("p95_ms"))
    place, size = min(n * 95 // 100, n - 1), n
    while size > most and low < high:
        number = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1))
        ranges = own.groupBy(number.alias("k")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(ranges.collect(), key=lambda r: r["k"]):
            if place < r["n"]:
                break
            place -= r["n"]
        size, low, high = r["n"], r["low"], r["high"]
        own = own.filter(F.col("x").between(low, high))
    return own.orderBy("x").offset(place).limit(1).agg(F.round(F.min("x"), 1).alias("p95_ms"))


def _by_query(events: DataFrame) -> DataFrame:
    return events.groupBy(F.lower(F.trim("query")).alias("key")).agg(F.min("query").alias("query"), F.count(F.lit(1)).alias("count"), F.round(F.avg("latency_ms"), 0).alias("avg_ms"), F.count_if("cache_hit").alias("cache_hits"))


def top_queries(events: DataFrame, limit: int = 20) -> DataFrame:
    """query (the smallest spelling), count, avg_ms, cache_hits, most frequent first."""
    return _by_query(events).orderBy(F.desc("count"), F.asc("key")).limit(limit).drop("key")


def warm_candidates(events: DataFrame, min_count: int = 3, limit: int = 50) -> DataFrame:
    """Frequent queries that never met the cache."""
    often = _by_query(events).filter((F.col("count") >= min_count) & (F.col("cache_hits") == 0))
    return often.orderBy(F.desc("count"), F.asc("key")).limit(limit).select("query", "count")


def hourly_volume(events: DataFrame) -> DataFrame:
    """hour (epoch seconds), queries, cache_hits, errors."""
    hour = (F.floor(F.unix_timestamp("ts") / 3600) * 3600).cast("long")
    return events.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("queries"), F.count_if("cache_hit").alias("cache_hits"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def error_log(events: DataFrame, limit: int = 50, tie: str = "session_id") -> DataFrame:
    return events.filter(F.col("error").isNotNull()).orderBy(F.desc("ts"), F.asc(tie)).limit(limit)


def purge(events: DataFrame, as_of: Column, keep_days: int = 30) -> DataFrame:
    """The events that stay."""
    return events.filter(F.col("ts") >= as_of - F.make_dt_interval(days=F.lit(keep_days)))


def worker_share(stats: DataFrame) -> DataFrame:
    """worker_id, rows_processed (sum), final_batch (of the last report), share in percent."""
    from pyspark.sql import Window

    own = stats.groupBy("worker_id").agg(F.sum("rows_processed").alias("rows_processed"), F.max_by("current_batch", "seq").alias("final_batch"))
    total = F.sum("rows_processed").over(Window.partitionBy(F.lit(0)))
    return own.withColumn("share", F.when(total == 0, 0.0).otherwise(F.round(100.0 * F.col("rows_processed") / total, 1)))
