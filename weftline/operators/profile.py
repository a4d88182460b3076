"""Which columns of a table are ids, dates, numbers and meaningful text, and
which types parsed texts get."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as tx
from weftline.model import Strategy

#: What a column's name says. ``\b`` doesn't part at underscores,
#: so ``id`` and ``row id`` are ids while ``user_id`` and ``created_at`` are neither.
ID_NAME = re.compile(r"\b(id|_id|pk|rowid|uuid|serial|key|code|number|num|no)\b", re.IGNORECASE)
DATE_NAME = re.compile(r"\b(date|time|created|modified|timestamp|updated)\b", re.IGNORECASE)
SKIP_NAME = re.compile(r"(password|hash|token|blob|binary|secret)", re.IGNORECASE)


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, non_null, distinct, ratio (0 where all is null): one pass over the table."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, non_null long, distinct long, ratio double")
    # the rows unpivot to (column, value); two aggregations with partial sums replace one wide distinct per column
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*")
    counted = pairs.groupBy("column", "value").agg(F.count("value").alias("n"))
    out = counted.groupBy("column").agg(F.sum("n").alias("non_null"), F.count("value").alias("distinct"))
    return out.withColumn("ratio", F.when(F.col("non_null") > 0, F.col("distinct") / F.col("non_null")).otherwise(0.0))


def classify(df: DataFrame, threshold: float = 0.3, sample_rows: int | None = None, order_by: str | None = None, shares: Callable[[DataFrame, list[str]], dict[str, float]] | None = None) -> Strategy:
    """The strategy of a table. Names decide first (id, date, skip), then types:
    numbers; text by the share of distinct values over the threshold, else an
    id. Booleans and other types take no part. ``sample_rows``: profile the
    first rows in an order only (as a paged reader would). ``shares``: where the
    shares of distinct values come from (``sketches.classify``), else all values are counted."""
    kinds = {f.name: f.dataType for f in df.schema}
    rowid = next((c for c in kinds if ID_NAME.search(c)), df.columns[0])
    strategy = Strategy(rowid, "")
    texts = []
    for name, kind in kinds.items():
        if ID_NAME.search(name):
            strategy.id_cols.append(name)
        elif DATE_NAME.search(name):
            strategy.date_cols.append(name)
        elif SKIP_NAME.search(name):
            strategy.skip_cols.append(name)
        elif isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType):
            strategy.numeric_cols.append(name)
        elif isinstance(kind, (T.StringType, T.NullType)):
            texts.append(name)
    profiled = df.select(*texts) if sample_rows is None else df.orderBy(order_by or rowid).limit(sample_rows).select(*texts)
    counted = shares or (lambda rows, columns: {r["column"]: r["ratio"] for r in cardinality(rows, columns).collect()})
    ratios = counted(profiled, texts) if texts else {}
    for name in texts:
        (strategy.semantic_cols if ratios.get(name, 0.0) > threshold else strategy.id_cols).append(name)
    strategy.id_cols.sort(key=df.columns.index)
    strategy.template = " | ".join(f"{c}: {{{c}}}" for c in strategy.text_cols)
    return strategy


def sql_types(schema: T.StructType) -> dict[str, str]:
    """INTEGER, REAL or TEXT for every column."""
    def one(kind: T.DataType) -> str:
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            return "INTEGER"
        return "REAL" if isinstance(kind, (T.FractionalType,)) else "TEXT"

    return {f.name: one(f.dataType) for f in schema}


def spark_type(sql: str) -> T.DataType:
    return {"INTEGER": T.LongType(), "REAL": T.DoubleType()}.get(sql, T.StringType())


def infer_types(documents: DataFrame, strategy: Strategy, samples: int | None = None, catalog: T.StructType | None = None) -> dict[str, str]:
    """Types of the strategy's columns: from the source's schema where there is
    one, else from all documents (or ``samples`` of them). Numeric columns: none seen or a
    point or exponent anywhere REAL, anything that is no number TEXT, else INTEGER."""
    cols = strategy.all_cols()
    out = {c: t for c, t in (sql_types(catalog) if catalog else {}).items() if c in cols}
    left = [c for c in strategy.numeric_cols if c not in out]
    if left:
        found = (documents if samples is None else documents.limit(samples)).select(tx.pairs(F.col("document")).alias("p"))
        values = [F.trim(tx.last_value(F.col("p"), c)).alias(c) for c in left]
        blank = lambda c: F.col(c).isNull() | F.lower(c).isin("", "none", "null")
        row = found.select(*values).agg(*[e for c in left for e in (
            F.count_if(~blank(c)).alias(f"{c}.n"), F.count_if(~blank(c) & F.col(c).try_cast("double").isNull()).alias(f"{c}.odd"), F.count_if(~blank(c) & F.col(c).rlike(r"(?i)[.e]|inf|nan")).alias(f"{c}.point"))]).first()
        for c in left:
            n, odd, point = (row[f"{c}.{x}"] for x in ("n", "odd", "point"))
            out[c] = "REAL" if not n else "TEXT" if odd else "REAL" if point else "INTEGER"
    return {c: out.get(c, "TEXT") for c in cols}


def seen_columns(documents: DataFrame, column: str = "document") -> DataFrame:
    """column, documents (how many hold it) of all keys in all documents, JSON
    objects and ``key: value`` texts: one pass, counted where the documents are read."""
    doc = F.col(column)
    own = F.when(F.ltrim(doc).startswith("{"), F.json_object_keys(doc)).otherwise(F.transform(tx.pairs(doc), lambda p: p["key"]))
    return documents.select(F.explode(F.array_distinct(own)).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("documents"))


def drift(documents: DataFrame, strategy: Strategy, most: int = 1000) -> list[str]:
    """Columns in the documents that the strategy lacks, in order of name: the
    ``most`` frequent ones (more are no columns of a table)."""
    known = [*strategy.all_cols(True), *strategy.skip_cols, strategy.rowid_col]
    new = seen_columns(documents).filter(~F.col("column").isin(known) & ~F.col("column").startswith("__"))
    return sorted(r["column"] for r in new.orderBy(F.desc("documents"), "column").limit(most).collect())


def json_types(documents: DataFrame, column: str = "document") -> dict[str, str]:
    """INTEGER, REAL or TEXT of every top-level key of the JSON objects among the
    documents, from the schema that all of them have together."""
    row = documents.filter(F.ltrim(column).startswith("{")).agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()
    if not row["s"] or not row["s"].startswith("OBJECT<"):
        return {}
    kinds = T.DataType.fromDDL(re.sub(r"\bOBJECT<", "STRUCT<", row["s"]).replace("VARIANT", "STRING").replace("VOID", "STRING"))
    return sql_types(T.StructType([T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, T.DecimalType) else f.dataType) for f in kinds.fields]))


def reconcile(strategy: Strategy, types: dict[str, str], seen: list[str] = ()) -> T.StructType:
    """The output table's schema: the strategy's columns, further seen ones in
    order of name, without names that start with two underscores, and the
    original row id at the end."""
    base = strategy.all_cols()
    drift = sorted(set(seen) - set(base))
    cols = [c for c in [*base, *drift] if not c.startswith("__")]
    return T.StructType([T.StructField(c, spark_type(types.get(c, "TEXT"))) for c in cols] + [T.StructField("__orig_rowid__", T.StringType())])


def ddl(schema: T.StructType, defaults: dict[str, str] | None = None) -> str:
    """Column definitions; defaults are copied, not-null and unique marks are not."""
    names = {T.LongType(): "INTEGER", T.DoubleType(): "REAL"}
    defaults = defaults or {}
    return ", ".join(f'"{f.name}" {names.get(f.dataType, "TEXT")}' + (f" DEFAULT {defaults[f.name]}" if f.name in defaults else "") for f in schema)
