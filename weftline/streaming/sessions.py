"""Conversations and the response cache as keyed state of a stream.

The same state stands as tables in ``operators.state``; here it lives in the
state store of a streaming query, which writes it to the checkpoint, deals it
out by key, and gives it back after a restart. A key's state is bounded: a
conversation holds its last turns only, a cache shard its most recently used
entries only; idle conversations end by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.state import cache_key

TURNS_OUT = "session_id string, turn long, ended boolean, turns long, history array<struct<role:string,content:string>>, last_active timestamp"
CACHE_OUT = "query_id string, cache_key string, response string, hit boolean, ts timestamp"
#: Times pass the processors as microseconds, whatever the session's time zone.
SECOND = 1_000_000


def need_state_store(spark) -> None:
    """Lists, maps and timers need the state store that keeps them on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Conversation(StatefulProcessor):
    def __init__(self, most: int, ttl_s: int):
        self.most, self.ttl_s = most, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "role string, content string")
        self.about = handle.getValueState("about", "turns long, last_active long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = list(self.turns.get()) if self.turns.exists() else []
        count, last = self.about.get() if self.about.exists() else (0, None)
        for row in sorted(rows, key=lambda r: (r["at"], r["turn"] is None, r["turn"])):
            if last is not None and row["at"] - last > self.ttl_s * SECOND:  # it ended before this turn came
                yield Row(session_id=key[0], turn=None, ended=True, turns=count, history=[Row(role=r, content=c) for r, c in held], last_active=last)
                held, count = [], 0
            held = [*held, (row["role"], row["content"])][-self.most :]
            count, last = count + 1, row["at"] if last is None else max(last, row["at"])
            yield Row(session_id=key[0], turn=row["turn"], ended=False, turns=count, history=[Row(role=r, content=c) for r, c in held], last_active=last)
        self.turns.put([tuple(t) for t in held])
        self.about.update((count, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.ttl_s * SECOND) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.about.exists():
            return
        count, last = self.about.get()
        held = list(self.turns.get()) if self.turns.exists() else []
        self.turns.clear()
        self.about.clear()
        yield Row(session_id=key[0], turn=None, ended=True, turns=count, history=[Row(role=r, content=c) for r, c in held], last_active=last)

    def close(self) -> None:
        pass


def conversations(turns: DataFrame, pairs: int = 10, ttl_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Of a stream of turns (session_id, turn, role, content, ts): for each turn the
    session's last 2 x pairs turns up to it, and one row with ``ended`` when a
    session has been idle for longer than its time to live, by event time. A turn
    that comes after that begins the session anew. Turns later than ``late`` go;
    so do rows without a session or a time."""
    need_state_store(turns.sparkSession)
    rows = turns.filter("session_id is not null and ts is not null").select("session_id", F.col("turn").cast("long").alias("turn"), "role", "content", "ts").withWatermark("ts", late)
    out = rows.withColumn("at", F.unix_micros("ts")).groupBy("session_id").transformWithState(_Conversation(2 * pairs, ttl_s), TURNS_OUT.replace("timestamp", "long"), "Append", "EventTime")
    return out.withColumn("last_active", F.timestamp_micros("last_active"))


class _Cache(StatefulProcessor):
    def __init__(self, entries: int, ttl_s: int):
        self.entries, self.ttl_s = entries, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "cache_key string", "response string, created_at long, last_used long, used long")
        self.clock = handle.getValueState("clock", "used long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {k[0]: list(v) for k, v in self.held.iterator()} if self.held.exists() else {}
        was = set(held)
        used = self.clock.get()[0] if self.clock.exists() else 0
        changed = set()
        for row in sorted(rows, key=lambda r: (r["at"], r["response"] is None, r["query_id"] or "")):
            used, name, now = used + 1, row["cache_key"], row["at"]
            entry = held.get(name)
            if entry is not None and now - entry[1] > self.ttl_s * SECOND:
                del held[name]
                entry = None
            if row["response"] is not None:  # an answer to keep
                if entry is None and len(held) >= self.entries:
                    old = [k for k, x in held.items() if now - x[1] > self.ttl_s * SECOND] or [min(held, key=lambda k: (held[k][2], held[k][3]))]
                    for k in old:
                        del held[k]
                held[name] = [row["response"], now, now, used]
                changed.add(name)
                continue
            if entry is not None:
                entry[2:] = [now, used]
                changed.add(name)
            yield Row(query_id=row["query_id"], cache_key=name, response=entry[0] if entry else None, hit=entry is not None, ts=now)
        for k in was - set(held):
            self.held.removeKey((k,))
        for k in changed & set(held):
            self.held.updateValue((k,), tuple(held[k]))
        self.clock.update((used,))

    def close(self) -> None:
        pass


def cached(asked: DataFrame, entries: int = 500, ttl_s: int = 300, shards: int = 1) -> DataFrame:
    """Of a stream of rows (query_id, query, response, ts): each row with a response
    is kept as the answer to its query, each without one is a question and comes
    out with the answer that the cache held then (null: a miss). Entries older
    than ``ttl_s`` don't count; where there is no room the least recently used
    goes. ``entries`` is the room of all ``shards`` together; a query's key
    decides its shard, so many shards share the work and each drops its own. Rows
    without a query or a time go."""
    need_state_store(asked.sparkSession)
    rows = asked.filter("query is not null and ts is not null").select(F.col("query_id").cast("string").alias("query_id"), cache_key(F.col("query")).alias("cache_key"), "response", F.unix_micros("ts").alias("at"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("cache_key"), F.lit(shards)).cast("int"))
    out = rows.groupBy("shard").transformWithState(_Cache(max(1, entries // shards), ttl_s), CACHE_OUT.replace("timestamp", "long"), "Append", "None")
    return out.withColumn("ts", F.timestamp_micros("ts"))
