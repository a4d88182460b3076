"""Sessions, response cache and rate limit as tables.

State tables are values: each function returns the new table, and the caller
writes it to a new version (``sources.collection`` shows how).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import search


def cache_key(query: Column) -> Column:
    """First 16 hex digits of SHA-256 of the query, stripped and in lower case."""
    stripped = F.regexp_replace(query, r"(?U)^\s+|\s+$", "")
    return F.substring(F.sha2(F.lower(stripped), 256), 1, 16)


def fresh(cache: DataFrame, now: Column, ttl_s: int = 300) -> DataFrame:
    """Entries that aren't older than the time to live."""
    return cache.filter(F.unix_timestamp("created_at") >= F.unix_timestamp(now) - ttl_s)


def cache_get(cache: DataFrame, queries: DataFrame, now: Column, ttl_s: int = 300) -> DataFrame:
    """queries with response (null: a miss) by exact key."""
    live = fresh(cache, now, ttl_s).select("cache_key", "response")
    return queries.withColumn("cache_key", cache_key(F.col("query"))).join(live, "cache_key", "left")


def semantic_get(cache: DataFrame, queries: DataFrame, now: Column, threshold: float = 0.95, ttl_s: int = 300) -> DataFrame:
    """queries (query_id, embedding) with response and similarity of the live
    entry (embedding, cache_key, response, created_at) whose vector is the
    closest, if it is close enough (else null: a miss); ties to the smaller key.
    Entries and queries meet in tiles (``search.top_k_batch``), none passes the driver."""
    live = fresh(cache, now, ttl_s)
    best = search.top_k_batch(live, queries, 1, "cache_key", query_col="query_id", threshold=threshold)
    found = best.join(live.select("cache_key", "response"), "cache_key").select("query_id", "response", "similarity")
    return queries.select("query_id").join(found, "query_id", "left")


def cache_put(cache: DataFrame, new: DataFrame, entries: int = 500) -> DataFrame:
    """The cache after newer entries replace older ones of the same key; of
    different keys the ``entries`` most recently used stay."""
    both = cache.unionByName(new)
    last = Window.partitionBy("cache_key").orderBy(F.desc("last_used"), F.desc("created_at"))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n").orderBy(F.desc("last_used"), F.asc("cache_key")).limit(entries)


def last_turns(turns: DataFrame, pairs: int = 10, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """The last 2 x pairs turns of every session."""
    newest = Window.partitionBy(session).orderBy(F.desc(turn))
    return turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= 2 * pairs).drop("_n")


def sessions(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """session, turns, created_at, last_active, the most recent first."""
    return turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.min("ts").alias("created_at"), F.max("ts").alias("last_active")).orderBy(F.desc("last_active"), F.asc(session))


def expire_sessions(listed: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    """Sessions that were active within the time to live."""
    return listed.filter(F.unix_timestamp("last_active") >= F.unix_timestamp(now) - ttl_s)


def sessionize(events: DataFrame, user: str = "user_id", gap_s: int = 3600) -> DataFrame:
    """Sessions of each user's events that a gap of more than ``gap_s`` parts:
    user, session_no (from 0), started, ended, events."""
    order = Window.partitionBy(user).orderBy("ts")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order)) > gap_s
    number = F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(order.rangeBetween(Window.unboundedPreceding, 0))
    return events.withColumn("session_no", number).groupBy(user, "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"))


def accepted(times: list[float], limit: int = 30, window_s: float = 60.0, held: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which of some ascending times a sliding limit accepts: fewer than
    ``limit`` accepted ones in the last ``window_s`` seconds. Rejected ones
    aren't recorded. Also the accepted times still held."""
    held = list(held or [])
    out = []
    for t in times:
        held = [x for x in held if t - x < window_s]
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


def rate_limit(events: DataFrame, session: str = "session_id", limit: int = 30, window_s: float = 60.0) -> DataFrame:
    """events with ``accepted``. Rows of a session are walked in the order of
    time in a stream of batches, so only the last accepted times are held."""
    cols = events.columns
    slim = events.withColumn("_t", F.col("ts").cast("timestamp").cast("double")).repartition(F.col(session)).sortWithinPartitions(session, "_t", *[c for c in cols if c not in (session, "ts")])

    def walk(batches):
        now, held = None, []
        for pdf in batches:
            keep = []
            for key, t in zip(pdf[session].tolist(), pdf["_t"].tolist(), strict=True):
                if key != now:
                    now, held = key, []
                ok, held = accepted([t], limit, window_s, held)
                keep += ok
            yield pdf[cols].assign(accepted=pd.Series(keep, index=pdf.index, dtype=bool))

    return slim.mapInPandas(walk, T.StructType([*events.schema.fields, T.StructField("accepted", T.BooleanType())]))
