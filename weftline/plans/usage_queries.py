"""Queries for usage analytics and state. The table ``events`` is read as query
events: errors are events of type error, cache hits those of type view, the
latency is the value, the query is the type with the user's group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import state, usage
from weftline.plans.search_queries import table


def as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" "), (F.col("user_id") % 7).cast("string")).alias("query"),
        (F.col("user_id") % 9).alias("retrieved_rows"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "view").alias("cache_hit"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
        "ts",
    )


def as_of(events: DataFrame) -> Column:
    """The newest event's time, as a literal."""
    return F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp")


_E = """
WITH e AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, ' ' || upper(event_type[1]) || substr(event_type, 2) || ' ' || (user_id % 7) AS query,
         user_id % 9 AS retrieved_rows, value AS latency_ms, event_type = 'view' AS cache_hit,
         CASE WHEN event_type = 'error' THEN 'failed' END AS error, ts FROM events
), now AS (SELECT max(ts) AS now FROM e)
"""


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = as_events(spark, sf_dir)
    return usage.summary(usage.since(events, as_of(events), 24 * 7), 24 * 7)


USAGE_SUMMARY = _E + """
SELECT 168 AS period_hours, count(*) AS total_queries, round(count_if(cache_hit) / count(*), 3) AS cache_hit_rate,
       round(avg(latency_ms), 1) AS avg_latency_ms, round(max(latency_ms), 1) AS max_latency_ms,
       round(avg(retrieved_rows), 1) AS avg_retrieved_rows, round(count(error) / count(*), 3) AS error_rate, count(error) AS errors
FROM e, now WHERE ts >= now - INTERVAL 168 HOUR
"""


def usage_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.p95_latency(as_events(spark, sf_dir))


USAGE_P95 = _E + """
, s AS (SELECT list_sort(list(latency_ms)) AS x FROM e WHERE NOT cache_hit AND latency_ms IS NOT NULL)
SELECT CASE WHEN len(x) > 0 THEN round(x[least(CAST(floor(len(x) * 95 / 100) AS BIGINT), len(x) - 1) + 1], 1) ELSE 0.0 END AS p95_ms FROM s
"""


def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.top_queries(as_events(spark, sf_dir), 20)


TOP_QUERIES = _E + """
SELECT min(query) AS query, count(*) AS count, round(avg(latency_ms), 0) AS avg_ms, CAST(count_if(cache_hit) AS BIGINT) AS cache_hits
FROM e GROUP BY lower(trim(query)) ORDER BY count(*) DESC, lower(trim(min(query))) LIMIT 20
"""


def warm_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.warm_candidates(as_events(spark, sf_dir), 3, 50)


WARM_CANDIDATES = _E + """
SELECT min(query) AS query, count(*) AS count FROM e GROUP BY lower(trim(query))
HAVING count(*) >= 3 AND count_if(cache_hit) = 0 ORDER BY count(*) DESC, lower(trim(min(query))) LIMIT 50
"""


def hourly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = as_events(spark, sf_dir)
    return usage.hourly_volume(usage.since(events, as_of(events), 48))


HOURLY_VOLUME = _E + """
SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour, count(*) AS queries, CAST(count_if(cache_hit) AS BIGINT) AS cache_hits, count(error) AS errors
FROM e, now WHERE ts >= now - INTERVAL 48 HOUR GROUP BY 1
"""


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.error_log(as_events(spark, sf_dir), 50, "event_id").select("event_id", "session_id", "query", "error")


ERROR_LOG = _E + "SELECT event_id, session_id, query, error FROM e WHERE error IS NOT NULL ORDER BY ts DESC, event_id LIMIT 50"


def ttl_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = as_events(spark, sf_dir)
    return usage.purge(events, as_of(events), 14).select("event_id", "session_id")


TTL_PURGE = _E + "SELECT event_id, session_id FROM e, now WHERE ts >= now - INTERVAL 14 DAY"


def sessions_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state.sessionize(table(spark, sf_dir, "events"))
    return found.select("user_id", "session_no", F.unix_timestamp("started").alias("started"), F.unix_timestamp("ended").alias("ended"), "events")


SESSIONS_1H = """
WITH g AS (SELECT user_id, ts, coalesce(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 3600, false) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, CAST(sum(CAST(gap AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_no FROM g)
SELECT user_id, session_no, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, CAST(floor(epoch(max(ts))) AS BIGINT) AS ended, count(*) AS events FROM n GROUP BY user_id, session_no
"""


def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that were active in the last day before the newest event."""
    events = as_events(spark, sf_dir)
    live = state.expire_sessions(state.sessions(events), as_of(events), 24 * 3600)
    return live.select("session_id", "turns", F.unix_timestamp("last_active").alias("last_active"))


ACTIVE_SESSIONS = _E + """
, s AS (SELECT session_id, count(*) AS turns, max(ts) AS last FROM e GROUP BY session_id)
SELECT session_id, turns, CAST(floor(epoch(last)) AS BIGINT) AS last_active FROM s, now WHERE floor(epoch(last)) >= floor(epoch(now)) - 86400
"""


def rate_limit_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three accepted events of a user in any hour; rejected ones don't count."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts", "event_id")
    return state.rate_limit(events, "session_id", 3, 3600.0).select("event_id", "session_id", "accepted")


RATE_LIMIT_ACCEPT = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, n, event_id, true AS accepted, [t] AS held FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.event_id, len(list_filter(r.held, lambda x: e.t - x < 3600)) < 3,
         CASE WHEN len(list_filter(r.held, lambda x: e.t - x < 3600)) < 3 THEN list_append(list_filter(r.held, lambda x: e.t - x < 3600), e.t) ELSE list_filter(r.held, lambda x: e.t - x < 3600) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1
)
SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, accepted FROM r
"""


def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two pairs of turns of every conversation."""
    return state.last_turns(table(spark, sf_dir, "conversations"), 2, "conv_id", "turn").select("conv_id", "turn", "role")


LAST_TURNS = "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4"


def worker_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and shares of workers, read from the lines' suppliers."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("worker_id"), F.lit(1).alias("rows_processed"), F.col("l_linenumber").alias("current_batch"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"))
    return usage.worker_share(lines).select("worker_id", "rows_processed", "final_batch", "share")


WORKER_SHARE = """
WITH w AS (
  SELECT l_suppkey % 8 AS worker_id, count(*) AS rows_processed, arg_max(l_linenumber, (l_orderkey, l_linenumber, l_partkey)) AS final_batch FROM lineitem GROUP BY 1
)
SELECT worker_id, rows_processed, final_batch, round(100.0 * rows_processed / CAST(sum(rows_processed) OVER () AS DOUBLE), 1) AS share FROM w
"""

QUERIES = {
    "usage_summary": (usage_summary, USAGE_SUMMARY),
    "usage_p95": (usage_p95, USAGE_P95),
    "top_queries": (top_queries, TOP_QUERIES),
    "warm_candidates": (warm_candidates, WARM_CANDIDATES),
    "hourly_volume": (hourly_volume, HOURLY_VOLUME),
    "error_log": (error_log, ERROR_LOG),
    "ttl_purge": (ttl_purge, TTL_PURGE),
    "sessions_1h": (sessions_1h, SESSIONS_1H),
    "active_sessions": (active_sessions, ACTIVE_SESSIONS),
    "rate_limit_accept": (rate_limit_accept, RATE_LIMIT_ACCEPT),
    "last_turns": (last_turns, LAST_TURNS),
    "worker_share": (worker_share, WORKER_SHARE),
}
