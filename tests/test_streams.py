"""Conversations, cache and usage over streams: equal to plain restatements and the table forms, through restarts."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators import state, usage
from weftline.streaming import sessions as ss
from weftline.streaming import usage_windows as uw

BEGAN = datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds):
    return (BEGAN + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(stream, out, checkpoint, mode="append"):
    """Take all that is there, file by file, and stop; the next call goes on from the checkpoint."""
    query = stream.writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


@pytest.fixture(autouse=True)
def few_partitions(spark):
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_conversations_are_trimmed_and_end_when_idle(spark, tmp_path):
    rng = random.Random(1)
    turns, clock = [], 0
    for n in range(60):
        clock += rng.choice([5, 40, 400])
        turns.append({"session_id": rng.choice("ab"), "turn": n, "role": rng.choice(["user", "assistant"]), "content": f"t{n}", "ts": at(clock)})
    far = clock + 100_000
    put(tmp_path / "in", "0.json", turns[:25])
    schema = "session_id string, turn long, role string, content string, ts timestamp"

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        run(ss.conversations(stream, pairs=2, ttl_s=900, late="0 seconds"), tmp_path / "out", tmp_path / "ckpt")

    go()
    put(tmp_path / "in", "1.json", turns[25:])  # after a restart
    go()
    put(tmp_path / "in", "2.json", [{"session_id": "z", "turn": 0, "role": "user", "content": "x", "ts": at(far)}])
    go()
    put(tmp_path / "in", "3.json", [{"session_id": None, "turn": 0, "ts": at(far)}, {"session_id": "z", "turn": 1, "role": "user", "content": "y", "ts": at(far + 1)}])
    go()
    got = spark.read.schema(ss.TURNS_OUT).json(str(tmp_path / "out")).collect()
    want, ended, held = {}, [], {}
    for t in turns:
        now, old = (datetime.fromisoformat(x["ts"]) if x else None for x in (t, held.get(t["session_id"], {}).get("last")))
        mine = held.setdefault(t["session_id"], {"rows": [], "n": 0})
        if old and (now - old).total_seconds() > 900:
            ended.append((t["session_id"], mine["n"], [c for _, c in mine["rows"]]))
            mine.update(rows=[], n=0)
        mine.update(rows=[*mine["rows"], (t["role"], t["content"])][-4:], n=mine["n"] + 1, last=t)
        want[t["turn"]] = (mine["n"], [c for _, c in mine["rows"]])
    ended += [(k, x["n"], [c for _, c in x["rows"]]) for k, x in held.items()]
    assert {r["turn"]: (r["turns"], [h["content"] for h in r["history"]]) for r in got if not r["ended"] and r["session_id"] != "z"} == want
    assert sorted((r["session_id"], r["turns"], [h["content"] for h in r["history"]]) for r in got if r["ended"]) == sorted(ended)
    last = {r["session_id"]: r for r in sorted((r for r in got if not r["ended"]), key=lambda r: r["turn"])}
    table = spark.createDataFrame([(t["session_id"], t["turn"], t["content"]) for t in turns], "session_id string, turn long, content string")
    by_table = {}
    for r in sorted(state.last_turns(table, 2).collect(), key=lambda r: r["turn"]):
        by_table.setdefault(r["session_id"], []).append(r["content"])
    for k, contents in by_table.items():  # the table form knows no end: the stream's history is its tail
        own = [h["content"] for h in last[k]["history"]]
        assert contents[-len(own) :] == own


def test_cache_expires_and_drops_the_least_used(spark, tmp_path):
    rng = random.Random(2)
    rows, clock = [], 0
    for n in range(150):
        clock += rng.choice([1, 10, 60])
        q = f"Question {rng.randint(0, 7)}"
        rows.append({"query_id": f"{n:03d}", "query": q if n % 2 else f" {q.upper()} ", "response": f"answer {n}" if rng.random() < 0.4 else None, "ts": at(clock)})
    schema = "query_id string, query string, response string, ts timestamp"

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        run(ss.cached(stream, entries=4, ttl_s=300), tmp_path / "out", tmp_path / "ckpt")

    put(tmp_path / "in", "0.json", rows[:70])
    go()
    put(tmp_path / "in", "1.json", [*rows[70:], {"query_id": "none", "query": None, "response": "x", "ts": at(clock)}])
    go()
    got = {r["query_id"]: r["response"] for r in spark.read.schema(ss.CACHE_OUT).json(str(tmp_path / "out")).collect()}
    held, want = {}, {}
    for n, r in enumerate(rows):
        now, key = datetime.fromisoformat(r["ts"]), r["query"].strip().lower()
        if key in held and (now - held[key][1]).total_seconds() > 300:
            del held[key]
        if r["response"] is not None:
            if key not in held and len(held) >= 4:
                for k in [k for k, x in held.items() if (now - x[1]).total_seconds() > 300] or [min(held, key=lambda k: held[k][2])]:
                    del held[k]
            held[key] = [r["response"], now, n]
        else:
            want[r["query_id"]] = held[key][0] if key in held else None
            if key in held:
                held[key][2] = n
    assert got == want and None in want.values() and any(want.values())


def query_events(n, seed=3):
    rng = random.Random(seed)
    out, clock = [], 0
    for i in range(n):
        clock += rng.choice([30, 300, 3700])
        out.append({"session_id": rng.choice("abc"), "query": f"q{i}", "latency_ms": float(rng.randint(1, 900)), "cache_hit": rng.random() < 0.3, "error": "down" if rng.random() < 0.2 else None, "ts": at(clock)})
    return out, clock


def test_usage_by_event_time_equals_the_table_form(spark, tmp_path):
    events, clock = query_events(120)
    mixed = events[:]
    mixed[40], mixed[44] = mixed[44], mixed[40]  # events come late, but not too late
    out = str(tmp_path / "hours")

    def go():
        stream = spark.readStream.schema(uw.QUERY_EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).filter("ts is not null")
        uw.keep_newest(uw.hourly(stream, "10 days"), out, str(tmp_path / "ckpt")).processAllAvailable()
        for q in spark.streams.active:
            q.stop()

    put(tmp_path / "in", "0.json", mixed[:50])
    go()
    put(tmp_path / "in", "1.json", mixed[50:])
    go()
    got = uw.newest(spark, out, "hour timestamp, queries long, errors long, cache_hits long, mean_latency_ms double")
    got = {(r["h"], r["queries"], r["errors"], r["cache_hits"]) for r in got.withColumn("h", F.unix_timestamp("hour")).collect()}
    table = spark.read.schema(uw.QUERY_EVENT).json(str(tmp_path / "in"))
    assert got == {(r["hour"], r["queries"], r["errors"], r["cache_hits"]) for r in usage.hourly_volume(table).collect()}


def test_sessions_and_errors_over_a_stream(spark, tmp_path):
    events, clock = query_events(80, 5)
    put(tmp_path / "in", "0.json", events[:40])
    put(tmp_path / "in", "1.json", events[40:])
    put(tmp_path / "in", "2.json", [dict(events[0], session_id="end", ts=at(clock + 10**6))])
    put(tmp_path / "in", "3.json", [dict(events[0], session_id="end", ts=at(clock + 2 * 10**6)), dict(events[0], session_id="late", ts=at(0))])
    stream = spark.readStream.schema(uw.QUERY_EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run(uw.sessions(stream), tmp_path / "s", tmp_path / "c1")
    got = {(r["session_id"], r["started"], r["ended"], r["events"]) for r in spark.read.schema("session_id string, started timestamp, ended timestamp, events long").json(str(tmp_path / "s")).collect() if r["session_id"] in "abc"}
    table = spark.read.schema(uw.QUERY_EVENT).json([str(tmp_path / "in" / n) for n in ("0.json", "1.json")])
    assert got == {(r["session_id"], r["started"], r["ended"], r["events"]) for r in state.sessionize(table, "session_id", 3600).collect()}
    assert not [r for r in spark.read.json(str(tmp_path / "s")).collect() if r["session_id"] == "late"]  # too late
    run(uw.error_log(uw.traced(spark, str(tmp_path / "in"))), tmp_path / "e", tmp_path / "c2")
    assert spark.read.json(str(tmp_path / "e")).count() == sum(e["error"] is not None for e in events) + (3 if events[0]["error"] else 0)
