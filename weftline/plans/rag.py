"""Whole runs: tables in, tables out, and a question answered."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import guards, rewrite
from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.model import QUERY_EVENT, TRACE_EVENT, TURN, Settings, Strategy
from weftline.operators import context, profile, search, state, usage
from weftline.sources import sinks
from weftline.sources.collection import Collection, append_new, collection_stats, entries, unprocessed, upserted
from weftline.sources.text_index import TextIndex


def new_entries(table: DataFrame, processed: DataFrame, embed=None, strategy: Strategy | None = None, source: str = "table", name: str = "rows") -> tuple[DataFrame, Strategy]:
    """Entries of the table's unprocessed rows, for ``Collection.change``, and the strategy."""
    strategy = strategy or profile.classify(table)
    return entries(unprocessed(table, processed, strategy.rowid_col), strategy, embed or vx.embedder(), source, name), strategy


def forward(table: DataFrame, collection: DataFrame, processed: DataFrame, embed=None, strategy: Strategy | None = None, source: str = "table", name: str = "rows") -> tuple[DataFrame, Strategy]:
    """The collection after the table's unprocessed rows went in, and the strategy."""
    new, strategy = new_entries(table, processed, embed, strategy, source, name)
    return upserted(collection, new), strategy


def reverse(collection: DataFrame, strategy: Strategy, kinds: dict[str, str] | None = None, target: DataFrame | None = None, drift: bool = True) -> DataFrame:
    """Typed rows recovered from a collection's documents, with __orig_rowid__;
    ids that the target already has stay out. Columns that only the documents have
    come after the strategy's, unless ``drift`` is false. No UDF and no embeddings read."""
    slim = collection.select("id", "document")
    sql = profile.infer_types(slim, strategy)
    more = profile.drift(slim, strategy) if drift else []
    sql |= {c: t for c, t in (profile.json_types(slim) if more else {}).items() if c in more}
    schema = profile.reconcile(strategy, sql, more)
    own = replace(strategy, semantic_cols=[*strategy.semantic_cols, *more])
    types = {f.name: f.dataType.simpleString() for f in schema} | (kinds or {})
    rows = tx.parse(slim.withColumnRenamed("id", "__orig_rowid__"), own, "document", "__orig_rowid__", types)
    rows = rows.filter("parsed").select(*schema.names)
    return rows if target is None else append_new(target, rows)


@dataclass
class Answer:
    answer: str
    session_id: str
    citations: list[dict] = field(default_factory=list)
    retrieved_rows: int = 0
    latency_ms: float = 0.0
    cache_hit: bool = False
    expanded_queries: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    blocked: bool = False
    reranked: bool = False


@dataclass
class Cached:
    answer: str
    made: float
    used: float
    vector: np.ndarray


@dataclass
class Engine:
    """Answers questions over a collection. encode: texts to vectors; complete:
    messages to text (the stand-in repeats what was retrieved); stream: messages
    to pieces of text; rows: the source table, by the strategy's row id; index: the
    documents' keyword index, else a hybrid question reads all documents; scorer: of
    question and document (``functions.models.pair_scorer``), ranks the hits anew. Sessions,
    cache and events are those of this process; ``save_events`` writes the latter
    for ``operators.usage``, and ``operators.state`` holds the same state as tables."""

    spark: SparkSession
    collection: Collection
    strategy: Strategy
    rows: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    encode: Callable = field(default_factory=vx.hashing_encoder)
    complete: Callable[[list[dict]], str] | None = None
    stream: Callable[[list[dict]], Iterator[str]] | None = None
    model_name: str = "stand-in"
    mode: str = "semantic"
    index: TextIndex | None = None
    scorer: Callable[[Column, Column], Column] | None = None
    clock: Callable[[], float] = time.time
    turns: dict[str, list[dict]] = field(default_factory=dict)
    active: dict[str, float] = field(default_factory=dict)
    asked: dict[str, list[float]] = field(default_factory=dict)
    cache: dict[str, Cached] = field(default_factory=dict)
    hits: dict[str, int] = field(default_factory=lambda: {"exact": 0, "semantic": 0, "miss": 0})
    events: list[dict] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)

    # --- sessions -----------------------------------------------------------

    def new_session(self) -> str:
        """A new session; those idle for longer than their time to live end."""
        now = self.clock()
        for old in [k for k, t in self.active.items() if now - t > self.settings.session_ttl_s]:
            self.delete_session(old)
        session = uuid.uuid4().hex
        self.turns[session], self.active[session] = [], now
        self._bound_sessions()
        return session

    def _bound_sessions(self) -> None:
        while len(self.turns) > self.settings.sessions:  # the longest idle ones make room
            self.delete_session(min(self.turns, key=lambda k: self.active[k]))

    def save_sessions(self, path: str) -> None:
        """Write all sessions' turns, as ``load_sessions`` and ``operators.state`` read them."""
        rows = [(k, n, t["role"], t["content"], datetime.fromtimestamp(self.active[k], UTC)) for k, turns in self.turns.items() for n, t in enumerate(turns)]
        self.spark.createDataFrame(rows, TURN).coalesce(1).write.mode("overwrite").json(path)

    def load_sessions(self, path: str) -> None:
        """Take up the sessions that were saved and haven't been idle for too long since."""
        saved = self.spark.read.schema(TURN).json(path)
        now = F.lit(datetime.fromtimestamp(self.clock(), UTC))
        live = state.expire_sessions(state.sessions(saved), now, self.settings.session_ttl_s).limit(self.settings.sessions).select("session_id", F.unix_micros("last_active").alias("at"))
        for r in state.last_turns(saved, self.settings.turn_pairs).join(live, "session_id").orderBy("session_id", "turn").collect():  # a bounded number of sessions and turns
            self.turns.setdefault(r["session_id"], []).append({"role": r["role"], "content": r["content"]})
            self.active[r["session_id"]] = r["at"] / 1e6
        self._bound_sessions()

    def delete_session(self, session: str) -> bool:
        for held in (self.active, self.asked):
            held.pop(session, None)
        return self.turns.pop(session, None) is not None

    def sessions(self) -> list[dict]:
        """The sessions, the most recently active first."""
        return [{"session_id": k, "turns": len(self.turns[k]), "last_active": self.active[k]} for k in sorted(self.turns, key=lambda k: -self.active[k])]

    def history(self, session: str) -> list[dict]:
        return self.turns.get(session, [])[-2 * self.settings.turn_pairs :]

    # --- cache --------------------------------------------------------------

    def cached(self, question: str) -> str | None:
        """The answer of the same question, or of one whose vector is close enough."""
        now, s = self.clock(), self.settings
        for k in [k for k, x in self.cache.items() if now - x.made > s.cache_ttl_s]:
            del self.cache[k]
        found, kind = self.cache.get(question.strip().lower()), "exact"
        if found is None and self.cache:
            vector = self._unit(question)
            near = max(self.cache.values(), key=lambda x: float(x.vector @ vector))
            found, kind = (near, "semantic") if float(near.vector @ vector) >= s.semantic_threshold else (None, "miss")
        self.hits[kind if found else "miss"] += 1
        if found is None:
            return None
        found.used = now
        return found.answer

    def remember(self, question: str, answer: str) -> None:
        key, now = question.strip().lower(), self.clock()
        if key not in self.cache and len(self.cache) >= self.settings.cache_entries:
            del self.cache[min(self.cache, key=lambda k: self.cache[k].used)]
        self.cache[key] = Cached(answer, now, now, self._unit(question))

    def cache_stats(self) -> dict:
        return {"entries": len(self.cache), **self.hits}

    def clear_cache(self) -> None:
        self.cache.clear()

    def _unit(self, text: str) -> np.ndarray:
        vector = np.asarray(self.encode([text])[0], dtype=np.float64)
        return vector / (np.linalg.norm(vector) + 1e-10)

    # --- retrieval ------------------------------------------------------------

    def _column(self, query: str, column):
        return self.spark.range(1).select(F.lit(query).alias("q")).select(column(F.col("q")).alias("r")).first()["r"]

    def retrieve(self, queries: list[str], question: str | None = None) -> DataFrame:
        """Ranked hits of all query variants, fused: rank, rowid, rrf_score,
        similarity, document, source and fields. One search serves all variants.
        Fields come from the source row where there is one, else from the
        document; those that are never shown are left out."""
        s, stored = self.settings, self.collection.read()
        probes = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(self.encode(queries))], "query_id long, embedding array<double>")
        found = search.top_k_batch(stored, probes, s.top_k, "id", query_col="query_id", threshold=s.similarity_threshold)
        lists = [found.select("id", "rank", "similarity")]
        if self.mode == "hybrid":
            words = re.findall(r"\w+", queries[0].lower())
            if self.index:
                hits = self.index.search(words, s.top_k, "id", s.bm25_k1, s.bm25_b)
            else:
                hits = search.bm25(stored, words, s.top_k, "id", "document", s.bm25_k1, s.bm25_b)
            lists.append(search.ranked(hits, "score", "id").withColumn("similarity", F.lit(0.0)))
        fused = search.fuse(lists, "id", s.rrf_k).orderBy(F.desc("rrf_score"), F.asc("id")).limit(s.top_k if self.scorer else s.rerank_top_n)
        out = search.ranked(fused, "rrf_score", "id").join(stored.select("id", "document", F.col("metadata")["source"].alias("source")), "id", "left")
        if self.scorer:
            best = search.rerank(out, self.scorer(F.lit(question or queries[0]), F.col("document")), s.rerank_top_n)
            out = search.ranked(best.drop("rank"), "rerank_score", "id")
        own = tx.fields(F.col("document"))
        if self.rows is not None:
            key, kinds = self.strategy.rowid_col, {f.name: f.dataType for f in self.rows.schema}
            row = F.array(*[F.struct(F.lit(c).alias("key"), tx.shown(c, kinds[c]).alias("value")) for c in tx.visible(self.rows.columns)])
            out = search.hydrate(out, self.rows.select(F.col(key).alias("key"), row.alias("fields")), "id", "key", "_row_").drop("_row_key")
            own = F.coalesce("_row_fields", own)
        return out.select("rank", F.col("id").alias("rowid"), "rrf_score", "similarity", "document", "source", tx.shown_fields(own).alias("fields"))

    # --- questions ------------------------------------------------------------

    def ask(self, question: str, session: str | None = None, use_cache: bool = True) -> Answer:
        for out in self._steps(question, session, use_cache, False):
            if isinstance(out, Answer):
                return out
        raise RuntimeError("no answer was made")

    def ask_stream(self, question: str, session: str | None = None, use_cache: bool = True) -> Iterator[str]:
        """The answer's pieces; the turn and its event are recorded after the last."""
        for out in self._steps(question, session, use_cache, True):
            if isinstance(out, str):
                yield out

    def _steps(self, question: str, session: str | None, use_cache: bool, streamed: bool) -> Iterator[str | Answer]:
        began, s = self.clock(), self.settings
        session = session if session in self.turns else self.new_session()
        guard = self._column(question, lambda q: guards.check_input(q, s))
        reason = guard["block_reason"]
        if not reason:  # only what passes all other checks counts
            allowed, self.asked[session] = state.accepted([began], s.queries_per_minute, 60.0, self.asked.get(session))
            reason = None if allowed[0] else guards.RATE_LIMITED % s.queries_per_minute
        if reason:
            yield reason
            yield self._done(question, Answer(reason, session, blocked=True), began, reason, turn=False)
            return
        asked = guard["modified_query"] or question
        known = self.cached(asked) if use_cache else None
        if use_cache:
            self._log("cache", session, hit=known is not None)
        if known is not None:
            yield known
            yield self._done(question, Answer(known, session, cache_hit=True, expanded_queries=[question], warnings=list(guard["warnings"])), began)
            return
        variants = self._column(asked, lambda q: rewrite.expand(q, s.variations))
        self._log("query", session, query=question, expanded=variants)
        summary, start = context.schema_summary(self.strategy), self.clock()
        found = context.build(self.retrieve(variants, asked), s, summary).first().asDict(True)
        self._log("retrieval", session, n_results=found["n"], latency_ms=(self.clock() - start) * 1000)
        start = self.clock()
        messages = context.prompt(asked, found["context"], self.history(session), summary, bool(found["n"]))
        text, error = "", None
        try:
            for piece in self._pieces(messages, found, streamed):
                text += piece
                yield piece
        except Exception as failed:  # whatever a client raises is answered and recorded
            error = str(failed)
            text = guards.FAILED % failed
            self._log("error", session, stage="llm", error=error)
            yield text
        warnings = list(guard["warnings"])
        if error is None:
            size = sum(len(m["content"]) for m in messages)
            self._log("llm_call", session, backend=self.backend, model=self.model_name, latency_ms=(self.clock() - start) * 1000, prompt_tokens=size // s.chars_per_token, completion_tokens=len(text) // s.chars_per_token)
            row = self.spark.createDataFrame([(text, found["documents"])], "t string, s array<string>").select(guards.check_output(F.col("t"), F.col("s"), s).alias("r")).first()["r"]
            text = row["modified_response"] or text
            warnings += row["warnings"]
            self.remember(asked, text)
        yield self._done(question, Answer(text, session, found["citations"], found["n"], expanded_queries=variants, warnings=warnings, reranked=bool(self.scorer and found["n"])), began, error)

    def _pieces(self, messages: list[dict], found: dict, streamed: bool) -> Iterator[str]:
        if streamed and self.stream:
            yield from self.stream(messages)
        elif self.complete:
            yield self.complete(messages)
        elif found["n"]:
            yield f"{found['n']} records match: "
            yield "; ".join(f"[{c['index']}] {d}" for c, d in zip(found["citations"], found["texts"], strict=True))
        else:
            yield context.NO_RECORDS

    def _done(self, question: str, out: Answer, began: float, error: str | None = None, turn: bool = True) -> Answer:
        now = self.clock()
        out.latency_ms, self.active[out.session_id] = (now - began) * 1000, now
        if turn:
            turns = [*self.turns[out.session_id], {"role": "user", "content": question}, {"role": "assistant", "content": out.answer}]
            self.turns[out.session_id] = turns[-2 * self.settings.turn_pairs :]
        at = datetime.fromtimestamp(now, UTC)
        self.events.append({"session_id": out.session_id, "query": question, "answer_length": len(out.answer), "retrieved_rows": out.retrieved_rows, "latency_ms": float(out.latency_ms), "cache_hit": out.cache_hit, "llm_backend": self.backend, "llm_model": self.model_name, "error": error, "warnings": out.warnings, "ts": at})
        return out

    @property
    def backend(self) -> str:
        return "callable" if self.complete or self.stream else "none"

    def _log(self, kind: str, session: str, **fields) -> None:
        self.log.append({"event": kind, "session_id": session, "ts": datetime.fromtimestamp(self.clock(), UTC), **fields})

    # --- reports ----------------------------------------------------------------

    def event_rows(self) -> DataFrame:
        """The recorded events as ``usage`` reads them."""
        rows = [tuple(e[f.name] for f in QUERY_EVENT) for e in self.events]
        return usage.record(self.spark.createDataFrame(rows, QUERY_EVENT))

    def save_events(self, path: str) -> None:
        """Append the events as JSON lines and forget them here."""
        sinks.trace(self.event_rows(), path)
        self.events.clear()

    def save_trace(self, path: str) -> None:
        """Append what was logged (query, retrieval, cache, llm_call, error) as JSON lines and forget it here."""
        rows = [tuple(e.get(f.name) for f in TRACE_EVENT) for e in self.log]
        sinks.trace(self.spark.createDataFrame(rows, TRACE_EVENT), path)
        self.log.clear()

    def analytics_summary(self, hours: int = 24) -> dict:
        now = F.lit(datetime.fromtimestamp(self.clock(), UTC))
        return usage.summary(usage.since(self.event_rows(), now, hours), hours).first().asDict()

    def health_check(self) -> dict:
        """What the engine stands on: the collection and its entries, sessions, cache and model."""
        stats = collection_stats(self.collection.read()).first()
        return {"status": "ok" if stats["total_entries"] else "empty", "collection": self.collection.version(), **stats.asDict(), "source_rows": self.rows is not None, "sessions": len(self.turns), "cache": self.cache_stats(), "model": self.model_name}
