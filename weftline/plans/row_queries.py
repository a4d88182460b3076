"""Queries for profiling, rows and texts, collections and change events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.model import Strategy
from weftline.operators import profile, search, sketches
from weftline.plans.search_queries import table
from weftline.sources import collection as co
from weftline.sources import sinks
from weftline.sources import tables as ta
from weftline.streaming import cdc


def serialize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", tx.serialize(rows, profile.classify(rows)).alias("document"))


SERIALIZE_ROWS = """
WITH k AS (SELECT count(DISTINCT c_mktsegment) / count(c_mktsegment) > 0.3 AS meant FROM customer)
SELECT c_custkey, concat_ws(' | ', 'c_name: ' || coalesce(c_name, 'None'),
  CASE WHEN meant THEN 'c_mktsegment: ' || coalesce(c_mktsegment, 'None') END,
  'c_custkey: ' || c_custkey, 'c_nationkey: ' || coalesce(CAST(c_nationkey AS VARCHAR), 'None'),
  'c_acctbal: ' || coalesce(CAST(c_acctbal AS VARCHAR), 'None'),
  CASE WHEN NOT meant THEN 'c_mktsegment: ' || coalesce(c_mktsegment, 'None') END) AS document
FROM customer, k
"""


def parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    strategy = profile.classify(rows)
    texts = rows.select(F.col("c_custkey").cast("string").alias("id"), tx.serialize(rows, strategy).alias("document"))
    kinds = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}
    back = tx.parse(texts, strategy, kinds=kinds)
    return back.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


PARSE_ROUNDTRIP = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def column_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["p_name", "p_brand", "p_type"]
    own = profile.cardinality(table(spark, sf_dir, "part"), names)
    more = profile.cardinality(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return own.unionByName(more).withColumn("ratio", F.round("ratio", 6))


COLUMN_CARDINALITY = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", round(count(DISTINCT {c}) / count({c}), 6) AS ratio FROM {t}"
    for t, c in (("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"))
)


def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of every column of part and orders."""
    out = []
    for name in ("part", "orders"):
        s = profile.classify(table(spark, sf_dir, name))
        for role, cols in (("semantic", s.semantic_cols), ("numeric", s.numeric_cols), ("id", s.id_cols), ("date", s.date_cols), ("skip", s.skip_cols)):
            out += [(name, c, role) for c in cols]
    return spark.createDataFrame(out, "table_name string, column_name string, role string")


def _role(t: str, c: str) -> str:
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) / count({c}) > 0.3 THEN 'semantic' ELSE 'id' END AS role FROM {t}"


SCHEMA_PROFILE = " UNION ALL ".join(
    [_role("part", c) for c in ("p_name", "p_brand", "p_type")]
    + [_role("orders", c) for c in ("o_orderstatus", "o_orderpriority")]
    + [f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'numeric' AS role" for t, c in (("part", "p_partkey"), ("part", "p_size"), ("part", "p_retailprice"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("orders", "o_totalprice"))]
)


def paged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ta.paged(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


PAGED_ROWS = "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 500) AS BIGINT) AS chunk_id FROM orders"


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return co.first_of_each(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"])


DEDUPE_FIRST = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n FROM lineitem) WHERE n = 1
"""


def upsert_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of orders after the finished ones came in again, each twice: the text that came first counts."""
    orders = table(spark, sf_dir, "orders")
    entry = lambda text: [F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("array<float>").alias("embedding"), text.alias("document"), F.create_map(F.lit("source"), F.lit("orders")).alias("metadata")]
    old = orders.select(*entry(F.col("o_orderstatus")))
    new = orders.filter("o_orderstatus = 'F'").select(*entry(F.concat("o_orderstatus", F.lit("*"), "o_orderpriority")))
    again = new.withColumn("document", F.lit("late")).withColumn("at", F.lit(2))
    return co.upserted(old, again.unionByName(new.withColumn("at", F.lit(1))), "at").select("id", "document")


UPSERT_APPLY = "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN 'F*' || o_orderpriority ELSE o_orderstatus END AS document FROM orders"


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line of more than 45 pieces: those still to do."""
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("row_id"))
    return co.unprocessed(table(spark, sf_dir, "orders"), done, "o_orderkey").select("o_orderkey", "o_orderstatus")


RESUME_ANTIJOIN = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"


def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that an insert without updates would add to the finished ones."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("__orig_rowid__"), "o_orderstatus")
    return co.append_new(orders.filter("o_orderstatus = 'F'"), orders.unionByName(orders))


APPEND_ONCE = "SELECT CAST(o_orderkey AS VARCHAR) AS __orig_rowid__, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of all vectors and all documents by their ids."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("document"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "embedding").join(texts, "k", "full")
    return co.collection_stats(rows.select(F.col("k").cast("string").alias("id"), "embedding", "document"))


COLLECTION_STATS = """
SELECT count(*) AS total_entries, coalesce(bool_or(text IS NOT NULL), false) AS has_documents, count(embedding) AS with_embedding
FROM documents FULL JOIN embeddings ON doc_id = vec_id
"""


def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an ingest of the orders is that wrote each of their lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.count(F.lit(1)).alias("rows_written"))
    return co.progress(lines)


INGEST_PROGRESS = "SELECT count(DISTINCT l_orderkey) AS processed, coalesce(max(l_orderkey), 0) AS last_row, count(*) AS rows_written FROM lineitem"


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the customer columns as the texts alone tell them."""
    rows = table(spark, sf_dir, "customer")
    strategy = profile.classify(rows)
    kinds = profile.infer_types(rows.select(tx.serialize(rows, strategy).alias("document")), strategy)
    return spark.createDataFrame(sorted(kinds.items()), "column_name string, sql_type string")


INFER_TYPES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN count({c}) = 0 OR bool_or(contains(CAST({c} AS VARCHAR), '.')) THEN 'REAL' ELSE 'INTEGER' END AS sql_type FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")
) + " UNION ALL " + " UNION ALL ".join(f"SELECT column_name, 'TEXT' AS sql_type FROM (DESCRIBE customer) WHERE column_name = '{c}' AND column_type = 'VARCHAR'" for c in ("c_name", "c_mktsegment"))


def cdc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as changes of users: errors delete, all else upserts; the last
    event of a user counts."""
    events = table(spark, sf_dir, "events")
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    image = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("name"))
    delete = F.col("event_type") == "error"
    value = F.to_json(F.struct(F.when(delete, "d").otherwise("u").alias("op"), F.when(delete, image).alias("before"), F.when(~delete, image).alias("after")))
    last = cdc.latest(cdc.changes(events.select(value.alias("value"), F.struct("ts", "event_id").alias("offset")), row))
    return last.filter("op = 'u'").select("rowid", F.col("after.name").alias("name"))


CDC_APPLY = """
SELECT CAST(user_id AS VARCHAR) AS rowid, event_type AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
WHERE n = 1 AND event_type <> 'error'
"""


def sketch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the orders by month, kept in two goes and merged: counts, and
    whether the estimated distinct values are within three standard errors of the
    exact ones."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    folder = f"{search.checkpoint_folder(spark)}/sketches-{uuid.uuid4().hex}"
    sketches.keep(spark, folder, orders.filter("o_orderdate < '1995-01-01'"), "month", columns)
    sketches.keep(spark, folder, orders, "month", columns)
    merged = sketches.merged(sketches.kept(spark, folder))
    exact = profile.cardinality(orders, columns).select("column", F.col("distinct").alias("exact"))
    close = F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact") + 1
    return merged.join(exact, "column").select("column", "rows", "non_null", F.col("exact").alias("distinct"), close.alias("close"))


SKETCH_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS distinct, true AS close FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
).replace("AS distinct", 'AS "distinct"')


def drift_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a mixed collection of customers' and suppliers' texts and events'
    JSON, and which of them a strategy made for the customers lacks."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    strategy = profile.classify(customers)
    texts = [rows.select(tx.serialize(rows, profile.classify(rows)).alias("document")) for rows in (customers, suppliers)]
    mixed = texts[0].unionByName(texts[1]).unionByName(table(spark, sf_dir, "events").select(F.col("props").alias("document")))
    known = [*strategy.all_cols(True), *strategy.skip_cols]
    return profile.seen_columns(mixed).select("column", "documents", (~F.col("column").isin(known)).alias("drift"))


DRIFT_COLUMNS = " UNION ALL ".join(
    f"SELECT column_name AS column, (SELECT count(*) FROM {name}) AS documents, {drift} AS drift FROM (DESCRIBE {name})" for name, drift in (("customer", "false"), ("supplier", "true"))
) + " UNION ALL SELECT k AS column, count(*) AS documents, true AS drift FROM (SELECT unnest(list_distinct(json_keys(props))) AS k FROM events) GROUP BY k"


def cdc_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of the users' first events that got all events in three batches,
    by event_id modulo 3, each a delta on top; what a later batch says counts."""
    events = table(spark, sf_dir, "events").filter("user_id is not null")
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    box = co.Collection(spark, f"{search.checkpoint_folder(spark)}/users-{uuid.uuid4().hex}", buckets=8)
    strategy = Strategy("id", "", ["name"], [], ["id"])
    first = events.groupBy(F.col("user_id").alias("id")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("name"))
    box.replace(co.entries(first, strategy, vx.embedder(), "events", "users"))
    image = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("name"))
    delete = F.col("event_type") == "error"
    value = F.to_json(F.struct(F.when(delete, "d").otherwise("u").alias("op"), F.when(delete, image).alias("before"), F.when(~delete, image).alias("after")))
    raw = events.select(value.alias("value"), F.struct("ts", "event_id").alias("offset"), F.pmod("event_id", F.lit(3)).alias("batch"))
    for number in range(3):
        cdc.apply(box, cdc.latest(cdc.changes(raw.filter(F.col("batch") == number), row)), strategy, vx.embedder(), "events", "users", ("events", number))
        box.tidy()
    return box.read().select("id", "document", F.size("embedding").cast("long").alias("dim"))


CDC_COLLECTION = """
WITH e AS (SELECT *, event_id % 3 AS batch FROM events WHERE user_id IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch DESC, ts DESC, event_id DESC) AS n FROM e)
SELECT CAST(user_id AS VARCHAR) AS id, 'name: ' || coalesce(event_type, 'None') || ' | id: ' || user_id AS document, CAST(64 AS BIGINT) AS dim
FROM l WHERE n = 1 AND event_type <> 'error'
"""


def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest status of the chunks of an ingest log read from the orders."""
    log = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("chunk_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"))
    return co.chunk_status(log)


CHUNK_STATUS = "SELECT status, count(*) AS chunks FROM (SELECT floor(o_orderkey / 100) AS c, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY c) GROUP BY status"


def chunk_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed chunks to try again, of a log made of the orders: priorities of chunks of ten keys
    are what happened to them in turn."""
    orders = table(spark, sf_dir, "orders")
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("1-URGENT", "running", "2-HIGH", "failed", "3-MEDIUM", "running", "4-NOT SPECIFIED", "failed", "5-LOW", "done")]), F.col("o_orderpriority"))
    log = orders.select(F.floor(F.col("o_orderkey") / 10).alias("chunk_id"), status.alias("status"), F.col("o_orderkey").alias("at"), F.concat(F.lit("order "), "o_orderkey").alias("error"))
    return co.to_retry(log, 5).select("chunk_id", "attempts", "error")


CHUNK_RETRY = """
WITH l AS (SELECT floor(o_orderkey / 10) AS chunk_id, o_orderkey AS k, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'running' WHEN o_orderpriority = '5-LOW' THEN 'done' WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') THEN 'failed' END AS status FROM orders)
SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(count_if(status = 'running') AS BIGINT) AS attempts, 'order ' || max(CASE WHEN status = 'failed' THEN k END) AS error
FROM l GROUP BY chunk_id HAVING arg_max(status, k) = 'failed' AND count_if(status = 'running') < 5
"""


def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt shows of every customer's text: its fields, the last of equal ones, less hidden ones."""
    rows = table(spark, sf_dir, "customer")
    more = F.when(F.col("c_custkey") % 3 == 0, F.lit(" | api_token: x | c_name: again")).otherwise(F.lit(" | api_token: x"))
    text = F.concat(tx.serialize(rows, profile.classify(rows)), more)
    shown = rows.select("c_custkey", tx.shown_fields(tx.fields(text)).alias("f"))
    of = lambda key: F.array_join(F.transform(F.filter("f", lambda f: f["key"] == key), lambda f: f["value"]), ",")
    return shown.select("c_custkey", F.size("f").cast("long").alias("fields"), of("c_name").alias("name"), of("c_nationkey").alias("nation"), F.exists("f", lambda f: f["key"] == "api_token").alias("leaks"))


DOCUMENT_FIELDS = """
SELECT c_custkey, (SELECT count(*) FROM (DESCRIBE customer)) AS fields, CASE WHEN c_custkey % 3 = 0 THEN 'again' ELSE coalesce(c_name, 'None') END AS name,
       coalesce(CAST(c_nationkey AS VARCHAR), 'None') AS nation, false AS leaks FROM customer
"""


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.aligned_lines(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))


EXPORT_LINES = """
WITH w AS (SELECT greatest(max(length(CAST(s_suppkey AS VARCHAR))), 9) AS a, greatest(max(length(s_name)), 6) AS b FROM supplier)
SELECT rpad(CAST(s_suppkey AS VARCHAR), CAST(a AS INTEGER), ' ') || ' | ' || rpad(s_name, CAST(b AS INTEGER), ' ') AS value FROM supplier, w
"""

QUERIES = {
    "serialize_rows": (serialize_rows, SERIALIZE_ROWS),
    "parse_roundtrip": (parse_roundtrip, PARSE_ROUNDTRIP),
    "column_cardinality": (column_cardinality, COLUMN_CARDINALITY),
    "schema_profile": (schema_profile, SCHEMA_PROFILE),
    "paged_rows": (paged_rows, PAGED_ROWS),
    "dedupe_first": (dedupe_first, DEDUPE_FIRST),
    "upsert_apply": (upsert_apply, UPSERT_APPLY),
    "resume_antijoin": (resume_antijoin, RESUME_ANTIJOIN),
    "append_once": (append_once, APPEND_ONCE),
    "collection_stats": (collection_stats, COLLECTION_STATS),
    "ingest_progress": (ingest_progress, INGEST_PROGRESS),
    "infer_types": (infer_types, INFER_TYPES),
    "cdc_apply": (cdc_apply, CDC_APPLY),
    "sketch_profile": (sketch_profile, SKETCH_PROFILE),
    "drift_columns": (drift_columns, DRIFT_COLUMNS),
    "cdc_collection": (cdc_collection, CDC_COLLECTION),
    "chunk_status": (chunk_status, CHUNK_STATUS),
    "chunk_retry": (chunk_retry, CHUNK_RETRY),
    "document_fields": (document_fields, DOCUMENT_FIELDS),
    "export_lines": (export_lines, EXPORT_LINES),
}
