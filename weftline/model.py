"""Settings and row types shared by the operators."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import types as T

COLLECTION = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("document", T.StringType(), True),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    ]
)

QUERY_EVENT = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("answer_length", T.LongType()),
        T.StructField("retrieved_rows", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("llm_backend", T.StringType()),
        T.StructField("llm_model", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("ts", T.TimestampType()),
    ]
)

TURN = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

#: What the engine logs of its steps; each kind of event fills some fields.
TRACE_EVENT = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("query", T.StringType()),
        T.StructField("expanded", T.ArrayType(T.StringType())),
        T.StructField("n_results", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("hit", T.BooleanType()),
        T.StructField("backend", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass
class Strategy:
    """How a table's columns take part in a row's text."""

    rowid_col: str
    template: str
    semantic_cols: list[str] = field(default_factory=list)
    numeric_cols: list[str] = field(default_factory=list)
    id_cols: list[str] = field(default_factory=list)
    date_cols: list[str] = field(default_factory=list)
    skip_cols: list[str] = field(default_factory=list)

    @property
    def text_cols(self) -> list[str]:
        """Columns of the text, in their order."""
        return [*self.semantic_cols, *self.numeric_cols, *self.id_cols, *self.date_cols]

    def all_cols(self, with_dates: bool = False) -> list[str]:
        """Columns that parsing recovers, each once; dates only if asked for."""
        cols = [*self.semantic_cols, *self.numeric_cols, *self.id_cols, *(self.date_cols if with_dates else [])]
        return list(dict.fromkeys(cols))

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Strategy:
        """Lists may also come as JSON text or as names with commas between."""
        raw = json.loads(text)
        known = {f.name for f in fields(cls)}
        out = {}
        for key, value in raw.items():
            if key not in known:
                continue
            if key.endswith("_cols") and isinstance(value, str):
                value = json.loads(value) if value.lstrip().startswith("[") else [x.strip() for x in value.split(",") if x.strip()]
            out[key] = value
        return cls(**out)


@dataclass
class Settings:
    """Tunable defaults."""

    top_k: int = 8
    rerank_top_n: int = 5
    similarity_threshold: float = 0.30
    variations: int = 3
    context_tokens: int = 6000
    chars_per_token: int = 4
    row_format: str = "markdown_table"
    truncate: int = 200
    turn_pairs: int = 10
    session_ttl_s: int = 3600
    sessions: int = 128
    cache_ttl_s: int = 300
    cache_entries: int = 500
    semantic_threshold: float = 0.95
    min_query: int = 2
    max_query: int = 1000
    queries_per_minute: int = 30
    blocked_keywords: tuple[str, ...] = ()
    block_injections: bool = True
    redact_query: bool = False
    redact_response: bool = False
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    cardinality: float = 0.3

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "WEFTLINE_") -> Settings:
        """Defaults overridden by variables named after the fields."""
        out = cls()
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            now = getattr(out, f.name)
            if isinstance(now, bool):
                value: object = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(now, tuple):
                value = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                value = type(now)(raw)
            setattr(out, f.name, value)
        return out
