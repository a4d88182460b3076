"""Rows to text and back, as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.model import Strategy

#: Fixed value: a key, a colon, and the value up to the next `` | key:`` or the end.
KV_PATTERN = r"(?sU)([\w][\w\s\.\-]*):\s*(.*?)(?=\s*\|\s*[\w][\w\s\.\-]*:|$)"
#: Fixed value: column names with one of these parts are never shown.
HIDDEN_PARTS = ("password", "password_hash", "secret", "token", "salt")
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed one time a row, however often
    ``use`` names it, in functions of array elements too."""
    return F.transform(F.array(value), use)[0]


def shown(column: Column | str, kind: T.DataType) -> Column:
    """A value as text that gives the same value back: doubles with all their
    digits, times in ISO form with what fractions they have, bytes as UTF-8."""
    c = F.col(column) if isinstance(column, str) else column
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if isinstance(kind, T.BinaryType):
        return F.decode(c, "UTF-8")
    return c.cast("string")


def serialize(df: DataFrame, strategy: Strategy) -> Column:
    """``name: value`` of the strategy's columns with `` | `` between; null is ``None``.
    A column that the table lacks leaves the present non-null semantic and numeric ones."""
    kinds = {f.name: f.dataType for f in df.schema}
    if all(c in kinds for c in strategy.text_cols):
        parts = [F.concat(F.lit(f"{c}: "), F.coalesce(shown(c, kinds[c]), F.lit("None"))) for c in strategy.text_cols]
    else:
        parts = [F.concat(F.lit(f"{c}: "), shown(c, kinds[c])) for c in [*strategy.semantic_cols, *strategy.numeric_cols] if c in kinds]
    return F.concat_ws(" | ", *parts)


def pairs(document: Column) -> Column:
    """array<struct<key, value>> of a document's ``key: value`` pairs, or null."""
    keys = F.regexp_extract_all(document, F.lit(KV_PATTERN), F.lit(1))
    values = F.regexp_extract_all(document, F.lit(KV_PATTERN), F.lit(2))
    zipped = F.zip_with(keys, values, lambda k, v: F.struct(F.trim(k).alias("key"), F.trim(v).alias("value")))
    return F.when(F.size(zipped) > 0, zipped)


def last_value(found: Column, key: str) -> Column:
    """The value of the last pair with this key, or null."""
    own = F.filter(found, lambda p: p["key"] == key)
    return F.try_element_at(own, F.lit(-1))["value"]


def coerce_number(value: Column, kind: str = "double") -> Column:
    """null, none and blanks are null; true and yes 1; false and no 0; else the number, or null."""
    v = F.lower(F.trim(value))
    number = v.try_cast("double")
    out = F.when(v.isin("", "none", "null"), F.lit(None).cast("double")).when(v.isin("true", "yes"), F.lit(1.0)).when(v.isin("false", "no"), F.lit(0.0)).otherwise(number)
    return out.try_cast(kind)


def coerce_text(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(value), '^"+|"+$', ""), "^'+|'+$", "")


def parse(df: DataFrame, strategy: Strategy, document: str = "document", rowid: str = "id", kinds: dict[str, str] | None = None, with_dates: bool = False) -> DataFrame:
    """The strategy's columns of every document, and ``parsed`` (false: no pairs).

    A document that starts with a brace is read as JSON, else as pairs. A
    missing row id comes from the entry's id. Text null stays the text
    ``None``; numeric None is null."""
    kinds = kinds or {}
    cols = strategy.all_cols(with_dates)
    is_json = F.ltrim(F.col(document)).startswith("{")
    as_map = F.from_json(F.when(is_json, F.col(document)), T.MapType(T.StringType(), T.StringType()))
    found = df.withColumn("_pairs", pairs(F.when(~is_json & (F.trim(document) != ""), F.col(document)))).withColumn("_map", as_map)
    out = []
    for c in cols:
        raw = F.coalesce(F.try_element_at("_map", F.lit(c)), last_value(F.col("_pairs"), c))
        if c == strategy.rowid_col:
            raw = F.coalesce(F.nullif(raw, F.lit("")), F.col(rowid).cast("string"))
        value = coerce_number(raw, kinds.get(c, "double")) if c in strategy.numeric_cols else coerce_text(raw)
        if c not in strategy.numeric_cols and c in kinds:
            value = value.try_cast(kinds[c])
        out.append(F.when(F.col("_ok"), value).alias(c))
    ok = F.coalesce(F.col("_pairs").isNotNull() | F.col("_map").isNotNull(), F.lit(False))
    keep = [F.col(c) for c in df.columns if c not in cols]
    return found.withColumn("_ok", ok).select(*keep, *out, F.col("_ok").alias("parsed"))


def truncated(value: Column, n: int) -> Column:
    return F.when(F.length(value) <= n, value).otherwise(F.concat(F.substring(value, 1, n - 1), F.lit("…")))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def fields(document: Column) -> Column:
    """array<struct<key, value>> of a document's ``key: value`` parts between
    bars, each key once at its first place with its last value."""
    parts = F.filter(F.transform(F.split(F.coalesce(document, F.lit("")), r"\|"), F.trim), lambda p: F.contains(p, F.lit(":")))
    named = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.substr(p, F.instr(p, ":") + 1)).alias("value")))
    last = lambda own, k: F.element_at(F.filter(own, lambda p: p["key"] == k), -1)["value"]
    return once(named, lambda own: F.transform(F.array_distinct(F.transform(own, lambda p: p["key"])), lambda k: F.struct(k.alias("key"), last(own, k).alias("value"))))


def shown_fields(found: Column) -> Column:
    """Fields without those that are never shown."""
    hidden = lambda k: reduce(lambda a, b: a | b, [F.contains(F.lower(k), F.lit(part)) for part in HIDDEN_PARTS])
    return F.filter(found, lambda p: ~hidden(p["key"]))


def visible(columns: list[str]) -> list[str]:
    return [c for c in columns if not any(part in c.lower() for part in HIDDEN_PARTS)]
