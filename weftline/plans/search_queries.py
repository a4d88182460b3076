"""Queries for search, fusion, guards and context."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import guards, rewrite
from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.model import Settings
from weftline.operators import context, search, state
from weftline.operators.neighbours import NeighbourIndex
from weftline.sources.tables import files_state
from weftline.sources.text_index import TextIndex

#: The keyword question: four tokens, one of them twice.
TOKENS = ["the", "thon", "einer", "the"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    probe = vectors.filter("vec_id = 0").first()["embedding"]
    return search.top_k(vectors, probe, 8, 0.30).select("vec_id", F.round("similarity", 6).alias("similarity"))


VECTOR_TOPK = """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, greatest(0.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.e)) AS s FROM embeddings, q),
t AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 8)
SELECT vec_id, round(s, 6) AS similarity FROM t WHERE s >= 0.30
"""


def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = search.top_k_batch(vectors, vectors.filter("vec_id % 50 = 0"), 5)
    return found.select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


VECTOR_TOPK_BATCH = """
WITH s AS (
  SELECT a.vec_id AS query_id, b.vec_id, greatest(0.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM r WHERE rank <= 5
"""


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index of cells and codes, looked into as a whole: all cells, all rows scored."""
    vectors = table(spark, sf_dir, "embeddings")
    index = NeighbourIndex(spark, f"{search.checkpoint_folder(spark)}/vectors-{uuid.uuid4().hex}")
    index.build(vectors, tested=False)
    found = index.search(vectors.filter("vec_id % 50 = 0"), 5, probes=len(index.model().cells), more=vectors.count())
    return found.select("query_id", "rank", "vec_id", F.round("similarity", 5).alias("similarity"))


VECTOR_INDEX_TOPK = VECTOR_TOPK_BATCH.replace("round(s, 6)", "round(s, 5)").replace("ORDER BY s DESC", "ORDER BY round(s, 7) DESC")


def semantic_cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest other entry of each probe, and whether it is close enough for a cached answer."""
    vectors = table(spark, sf_dir, "embeddings")
    best = search.top_k_batch(vectors, vectors.filter("vec_id % 50 = 0"), 1)
    return best.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= 0.95).alias("hit"))


SEMANTIC_CACHE_HIT = """
WITH s AS (
  SELECT a.vec_id AS query_id, b.vec_id, greatest(0.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM s)
SELECT query_id, vec_id, round(s, 6) AS similarity, s >= 0.95 AS hit FROM r WHERE n = 1
"""


def semantic_cache_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector looked up in a cache of all others, those with the smallest ids expired."""
    vectors = table(spark, sf_dir, "embeddings")
    cache = vectors.filter("vec_id % 50 <> 0").select(F.col("vec_id").alias("cache_key"), "embedding", F.concat(F.lit("label "), "label").alias("response"), F.timestamp_seconds("vec_id").alias("created_at"))
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = state.semantic_get(cache, asked, F.timestamp_seconds(F.lit(400)), 0.5)
    return found.select("query_id", F.coalesce("response", F.lit("-")).alias("response"), F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"))


SEMANTIC_CACHE_GET = """
WITH s AS (
  SELECT a.vec_id AS query_id, b.label, greatest(0.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s, b.vec_id
  FROM embeddings a JOIN embeddings b ON b.vec_id % 50 <> 0 AND b.vec_id >= 100 WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM s)
SELECT e.vec_id AS query_id, coalesce('label ' || r.label, '-') AS response, round(coalesce(r.s, 0.0), 6) AS similarity
FROM embeddings e LEFT JOIN r ON e.vec_id = r.query_id AND n = 1 AND r.s >= 0.5 WHERE e.vec_id % 50 = 0
"""


def documents_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of the documents: made by the first query of a session that
    needs it, found by the others as long as the table's files stay as they are."""
    made = hashlib.md5("\n".join(files_state(spark, f"{sf_dir}/documents.parquet")).encode()).hexdigest()
    index = TextIndex(spark, f"{search.checkpoint_folder(spark)}/documents-index-{made}")
    if index.newest() is None:
        index.upsert(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).search(TOKENS, 10).select("doc_id", F.round("score", 6).alias("score"))


_BM25 = """
docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs),
q AS (SELECT unnest(['the', 'thon', 'einer', 'the']) AS term),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT term FROM q) JOIN docs ON list_contains(t, term) GROUP BY term),
tf AS (SELECT doc_id, len(t) AS len, term, CAST(len(list_filter(t, lambda x: x = term)) AS DOUBLE) AS tf FROM docs JOIN q ON list_contains(t, term)),
bm25 AS (
  SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score
  FROM tf JOIN df USING (term), n GROUP BY doc_id
)
"""

BM25_TOPK = f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, doc_id LIMIT 10"


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return documents_index(spark, sf_dir).search_batch(items, 3).select("query_id", "rank", "doc_id", F.round("score", 5).alias("score"))


BM25_BATCH = """
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs),
post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score
  FROM post JOIN q USING (term) JOIN df USING (term), n GROUP BY ALL
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, doc_id, round(score, 5) AS score FROM r WHERE rank <= 3
"""


def _two_lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    docs = table(spark, sf_dir, "documents")
    words = search.ranked(documents_index(spark, sf_dir).search(TOKENS, 20), "score").withColumn("similarity", F.lit(0.0))
    long = docs.orderBy(F.desc("n_chars"), F.asc("doc_id")).limit(20).select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return [words, search.ranked(long, "score").withColumn("similarity", F.lit(0.5))]


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the best documents by BM25 and by length."""
    fused = search.fuse(_two_lists(spark, sf_dir))
    return fused.select("doc_id", F.round("rrf_score", 8).alias("rrf_score"), "similarity", "lists")


_RRF = f"""
WITH {_BM25},
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 0.0 AS sim FROM bm25),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, 0.5 AS sim FROM documents),
fused AS (
  SELECT doc_id, sum(1.0 / (60 + rank)) AS rrf, CAST(max(sim) AS DOUBLE) AS similarity, count(*) AS lists
  FROM (SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20) GROUP BY doc_id
)
"""

RRF_FUSE = _RRF + "SELECT doc_id, round(rrf, 8) AS rrf_score, similarity, lists FROM fused"


def hybrid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best fused hits with their rows; hits without a row stay."""
    fused = search.fuse(_two_lists(spark, sf_dir)).orderBy(F.desc("rrf_score"), F.asc("doc_id")).limit(5)
    rows = search.hydrate(fused.select("doc_id", "rrf_score"), table(spark, sf_dir, "labels"), "doc_id", "doc_id", "row_")
    return rows.select("doc_id", F.round("rrf_score", 8).alias("rrf_score"), F.coalesce("row_quality", F.lit(-1)).cast("long").alias("row_quality"), F.coalesce("row_toxic", F.lit(-1)).cast("long").alias("row_toxic"))


HYBRID_LOOKUP = _RRF + """, best AS (SELECT * FROM fused ORDER BY rrf DESC, doc_id LIMIT 5)
SELECT b.doc_id, round(rrf, 8) AS rrf_score, CAST(coalesce(l.quality, -1) AS BIGINT) AS row_quality, CAST(coalesce(l.toxic, -1) AS BIGINT) AS row_toxic FROM best b LEFT JOIN labels l ON b.doc_id = l.doc_id"""


def rerank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 candidates in a new order by token overlap, as probabilities."""
    docs = table(spark, sf_dir, "documents")
    hits = search.ranked(documents_index(spark, sf_dir).search(TOKENS, 20), "score").join(docs.select("doc_id", "text"), "doc_id")
    out = search.rerank(hits, search.overlap_scorer(TOKENS, "text"), 5)
    return out.select("doc_id", F.col("rank").cast("int").alias("rank"), F.round("similarity", 6).alias("similarity"))


RERANK_TOPN = f"""
WITH {_BM25},
a AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm25),
s AS (
  SELECT a.doc_id, rank, 4.0 * len(list_filter(['the', 'thon', 'einer'], lambda x: list_contains(t, x))) / 3 - 2.0 AS s
  FROM a JOIN docs USING (doc_id) WHERE rank <= 20
)
SELECT doc_id, rank, round(1 / (1 + exp(-s)), 6) AS similarity FROM s ORDER BY s DESC, rank LIMIT 5
"""


def pii_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guards.pii_kinds(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("kinds")).filter("kinds <> ''")


def _duck(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


PII_DETECT = (
    "SELECT * FROM (SELECT doc_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN regexp_matches(text, '{_duck(p)}') THEN '{k}' END" for k, p in guards.PII_PATTERNS.items())
    + ") AS kinds FROM documents) WHERE kinds <> ''"
)


def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = guards.redacted(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("redacted_sha256"), (F.length(text) - F.length("text")).cast("long").alias("grown"))


_redacted = "text"
for _k, _p in guards.PII_PATTERNS.items():
    _redacted = f"regexp_replace({_redacted}, '{_duck(_p)}', '[REDACTED_{_k.upper()}]', 'g')"
PII_REDACT = f"SELECT doc_id, sha256(r) AS redacted_sha256, CAST(length(r) - length(text) AS BIGINT) AS grown FROM (SELECT doc_id, text, {_redacted} AS r FROM documents)"


def injection_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the patterns each turn matches, of all turns."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.size(guards.injections(F.coalesce("text", F.lit("")))).cast("long").alias("patterns"))


def _duck_injection(p: str) -> str:
    head, look, tail = p.partition("(?!")
    if not look:
        return f"regexp_matches(coalesce(text, ''), '(?i){p}')"
    rest = tail.rstrip(")")
    one = head.removesuffix(r"\s+") + r"\s"
    return f"regexp_matches(regexp_replace(coalesce(text, ''), '(?i){one}{rest}', '', 'g'), '(?i){one}')"


INJECTION_DETECT = "SELECT conv_id, turn, CAST(" + " + ".join(f"CAST({_duck_injection(p)} AS INTEGER)" for p in guards.INJECTION_PATTERNS) + " AS BIGINT) AS patterns FROM conversations"


def input_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input guard's decision on every turn."""
    turns = table(spark, sf_dir, "conversations")
    checked = turns.select("conv_id", "turn", guards.check_input(F.col("text")).alias("g"))
    return checked.select("conv_id", "turn", "g.allowed", "g.block_reason", F.array_join("g.warnings", "; ").alias("warnings"))


INPUT_GUARD = f"""
WITH f AS (
  SELECT conv_id, turn, text, length(text) AS n, patterns,
         concat_ws(', ', {", ".join(f"CASE WHEN regexp_matches(text, '{_duck(p)}') THEN '{k}' END" for k, p in guards.PII_PATTERNS.items())}) AS kinds
  FROM conversations JOIN ({INJECTION_DETECT}) USING (conv_id, turn)
), r AS (
  SELECT *, CASE WHEN text IS NULL OR n < 2 THEN 'Query too short' WHEN n > 1000 THEN 'Query exceeds 1000 character limit'
                 WHEN patterns > 0 THEN 'Potential prompt injection detected' END AS block_reason FROM f
)
SELECT conv_id, turn, block_reason IS NULL AS allowed, block_reason,
       CASE WHEN block_reason IS NULL AND kinds <> '' THEN 'Query may contain PII: ' || kinds ELSE '' END AS warnings
FROM r
"""


def number_hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns against the other turns' texts before them in the conversation."""
    turns = table(spark, sf_dir, "conversations")
    own = turns.select("conv_id", "turn", "role", F.explode_outer(guards.numbers(F.coalesce("text", F.lit("")))).alias("number"))
    # a number is known to an assistant's turn if another's first turn with it comes before
    first = own.filter("role <> 'assistant' and number is not null").groupBy("conv_id", "number").agg(F.min("turn").alias("first"))
    value = F.col("number").try_cast("decimal(38,0)")
    odd = F.col("number").isNotNull() & F.coalesce(~value.between(1900, 2100) & (value > 10), F.lit(True)) & F.coalesce(F.col("first") >= F.col("turn"), F.lit(True))
    out = own.filter("role = 'assistant'").join(first, ["conv_id", "number"], "left").groupBy("conv_id", "turn").agg(F.count_if(odd).alias("unsupported"))
    return out.select("conv_id", "turn", "unsupported", (F.col("unsupported") > 3).alias("warned"))


NUMBER_HALLUCINATION = r"""
WITH n AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(coalesce(text, ''), '\b\d{2,}\b')) AS own FROM conversations),
known AS (
  SELECT a.conv_id, a.turn, list_distinct(coalesce(flatten(list(b.own) FILTER (WHERE b.own IS NOT NULL)), [])) AS known
  FROM n a LEFT JOIN n b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.role <> 'assistant'
  WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn
), odd AS (
  SELECT n.conv_id, n.turn, len(list_filter(own, lambda x: NOT list_contains(known, x) AND coalesce(NOT (TRY_CAST(x AS HUGEINT) BETWEEN 1900 AND 2100) AND TRY_CAST(x AS HUGEINT) > 10, true))) AS k
  FROM n JOIN known USING (conv_id, turn) WHERE role = 'assistant'
)
SELECT conv_id, turn, CAST(k AS BIGINT) AS unsupported, k > 3 AS warned FROM odd
"""


#: What stands before a turn's text, to make a question of it that each rule of the expansion meets.
_LEADS = ("find ", "show me new ", "inactive ", "germany ", "+91 ")


def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of questions made of all turns: how many, and their digest."""
    lead = F.element_at(F.array(*[F.lit(x) for x in _LEADS]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("int"))
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", rewrite.expand(F.concat(lead, F.coalesce("text", F.lit("")))).alias("v"))
    return asked.select("conv_id", "turn", F.size("v").cast("long").alias("n_variants"), F.sha2(F.array_join("v", "#"), 256).alias("variants_sha256"))


def _holds(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


QUERY_REWRITE = f"""
WITH t AS (SELECT conv_id, turn, {list(_LEADS)}[(conv_id + turn) % 5 + 1] || coalesce(text, '') AS query FROM conversations),
l AS (SELECT *, lower(query) AS q FROM t),
p AS (
  SELECT *, CASE {" ".join(f"WHEN contains(q, '{k}') THEN replace(q, '{k}', '{v}')" for k, v in rewrite.COUNTRIES.items())} END AS country,
         regexp_extract(q, '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])([\\p{{L}}\\p{{M}}\\p{{N}}_]+)\\s+(?:email|account|mail)(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1) AS domain,
         regexp_extract(query, '{rewrite.DIALLING_CODE}', 1) AS phone, trim(regexp_replace(q, '{rewrite.LEAD}', '')) AS bare
  FROM l
), v AS (
  SELECT conv_id, turn, list_transform(list_filter([query, country,
    CASE WHEN {_holds(rewrite.ACTIVE)} THEN query || ' is_active 1' END, CASE WHEN {_holds(rewrite.INACTIVE)} THEN query || ' is_active 0' END,
    CASE WHEN {_holds(rewrite.RECENT)} THEN query || ' created_at recent registration' END, CASE WHEN domain <> '' THEN '@' || domain || '.com email' END,
    CASE WHEN phone <> '' THEN 'phone_number ' || phone END, CASE WHEN bare <> '' AND bare <> q THEN bare END
  ], lambda x: x IS NOT NULL), lambda x: trim(x)) AS v FROM p
), f AS (SELECT *, list_transform(v, lambda x: lower(x)) AS f FROM v),
u AS (SELECT conv_id, turn, list_filter(v, lambda x, i: list_position(f, lower(x)) = i)[1:4] AS u FROM f)
SELECT conv_id, turn, CAST(len(u) AS BIGINT) AS n_variants, sha256(array_to_string(u, '#')) AS variants_sha256 FROM u
"""


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache key of every turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", state.cache_key(F.col("text")).alias("cache_key"))


CACHE_KEYS = "SELECT conv_id, turn, substr(sha256(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13)))), 1, 16) AS cache_key FROM conversations"


def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns looked up in a cache of the assistants' turns, which keeps the last answer of each key."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    at = F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn"))
    filled = state.cache_put(turns.limit(0).select(F.lit("").alias("cache_key"), F.col("text").alias("response"), at.alias("created_at"), at.alias("last_used")), turns.filter("role = 'assistant'").select(state.cache_key(F.col("text")).alias("cache_key"), F.concat_ws("/", "conv_id", "turn").alias("response"), at.alias("created_at"), at.alias("last_used")), 1_000_000)
    found = state.cache_get(filled, turns.select("conv_id", "turn", F.col("text").alias("query")), F.lit("1970-01-01").cast("timestamp"), 300)
    return found.select("conv_id", "turn", F.coalesce("response", F.lit("-")).alias("response"))


RESPONSE_CACHE = """
WITH k AS (SELECT conv_id, turn, role, substr(sha256(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13)))), 1, 16) AS key FROM conversations WHERE text IS NOT NULL),
c AS (SELECT key, arg_max(conv_id || '/' || turn, conv_id * 1000 + turn) AS response FROM k WHERE role = 'assistant' GROUP BY key)
SELECT conv_id, turn, coalesce(response, '-') AS response FROM k LEFT JOIN c USING (key)
"""


def response_cache_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache with room for fifty answers and five hours to live, filled by the
    assistants' turns an hour of each conversation apart; all turns looked up."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    at = F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn"))
    new = turns.filter("role = 'assistant'").select(state.cache_key(F.col("text")).alias("cache_key"), F.concat_ws("/", "conv_id", "turn").alias("response"), at.alias("created_at"), at.alias("last_used"))
    filled = state.cache_put(new.limit(0), new, 50)
    now = F.timestamp_seconds(F.lit(turns.agg(F.max("conv_id")).first()[0] * 3600))
    found = state.cache_get(filled, turns.select("conv_id", "turn", F.col("text").alias("query")), now, 5 * 3600)
    return found.select("conv_id", "turn", F.coalesce("response", F.lit("-")).alias("response"))


RESPONSE_CACHE_FULL = """
WITH k AS (SELECT conv_id, turn, role, conv_id * 3600 + turn AS moment, substr(sha256(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13)))), 1, 16) AS key FROM conversations WHERE text IS NOT NULL),
c AS (SELECT key, max(moment) AS last, arg_max(conv_id || '/' || turn, moment) AS response FROM k WHERE role = 'assistant' GROUP BY key),
f AS (SELECT * FROM c ORDER BY last DESC, key LIMIT 50),
l AS (SELECT * FROM f WHERE last >= (SELECT max(conv_id) FROM k) * 3600 - 5 * 3600)
SELECT conv_id, turn, coalesce(response, '-') AS response FROM k LEFT JOIN l USING (key)
"""


def output_guard_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer to its neighbour by id: numbers that the neighbour
    lacks are unsupported, and personal data is taken out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sources = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("source"))
    both = docs.join(sources, "doc_id")
    checked = both.select("doc_id", "text", guards.check_output(F.coalesce("text", F.lit("")), F.array(F.coalesce("source", F.lit(""))), Settings(redact_response=True)).alias("g"))
    shown = F.coalesce("g.modified_response", "text", F.lit(""))
    return checked.select("doc_id", "g.safe", F.array_join("g.warnings", "; ").alias("warnings"), F.sha2(shown, 256).alias("shown_sha256"))


OUTPUT_GUARD_SOURCES = rf"""
WITH d AS (SELECT a.doc_id, coalesce(a.text, '') AS text, coalesce(b.text, '') AS source FROM documents a JOIN documents b ON a.doc_id = b.doc_id + 1),
n AS (
  SELECT *, list_distinct(regexp_extract_all(text, '\b\d{{2,}}\b')) AS own, regexp_extract_all(source, '\b\d{{2,}}\b') AS known,
         concat_ws(', ', {", ".join(f"CASE WHEN regexp_matches(text, '{_duck(p)}') THEN '{k}' END" for k, p in guards.PII_PATTERNS.items())}) AS kinds FROM d
), k AS (
  SELECT *, len(list_filter(own, lambda x: NOT list_contains(known, x) AND coalesce(NOT (TRY_CAST(x AS HUGEINT) BETWEEN 1900 AND 2100) AND TRY_CAST(x AS HUGEINT) > 10, true))) AS odd FROM n
)
SELECT doc_id, odd <= 3 AS safe,
       concat_ws('; ', CASE WHEN kinds <> '' THEN 'PII redacted from response: ' || kinds END, CASE WHEN odd > 3 THEN 'Response contains ' || odd || ' numbers not found in retrieved data' END) AS warnings,
       sha256({_redacted}) AS shown_sha256
FROM k
"""


def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as rows of a context in each of the formats: digest and cost."""
    field = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("rank"), ((F.pmod(F.col("conv_id"), F.lit(100)) + 0.5) / 128).alias("similarity"), F.array(field("role", F.col("role")), field("text", F.col("text"))).alias("fields"))
    of = lambda fmt: context.row_text(fmt, F.col("rank"), F.col("similarity"), F.col("fields"), 60)
    columns = [c for fmt in context.FORMATS for c in (F.sha2(of(fmt), 256).alias(f"{fmt}_sha256"), F.length(of(fmt)).cast("long").alias(f"{fmt}_cost"))]
    return turns.select("conv_id", "turn", *columns)


_CUT = "CASE WHEN length({0}) <= 60 THEN {0} ELSE substr({0}, 1, 59) || '…' END"
CONTEXT_ROWS = f"""
WITH t AS (SELECT conv_id, turn, turn + 1 AS rank, (conv_id % 100 + 0.5) / 128 AS sim, coalesce(role, 'None') AS r, coalesce(text, 'None') AS x FROM conversations),
c AS (SELECT *, {_CUT.format("r")} AS rc, {_CUT.format("x")} AS xc FROM t),
f AS (
  SELECT conv_id, turn, '| [' || rank || '] | ' || rc || ' | ' || xc || ' |' AS md,
         '  {{' || chr(10) || '    "_ref": ' || rank || ',' || chr(10) || '    "similarity": ' || CAST(round(sim, 3) AS VARCHAR) || ',' || chr(10) || '    "role": ' || to_json(r) || ',' || chr(10) || '    "text": ' || to_json(x) || chr(10) || '  }}' AS js,
         '[' || rank || '] Similarity=' || printf('%.2f', sim) || chr(10) || '  role: ' || rc || chr(10) || '  text: ' || xc AS kv FROM c
)
SELECT conv_id, turn, sha256(md) AS markdown_table_sha256, length(md) AS markdown_table_cost, sha256(js) AS json_sha256, length(js) AS json_cost, sha256(kv) AS key_value_sha256, length(kv) AS key_value_cost FROM f
"""


def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of the best documents of the keyword question, in each format."""
    hits = search.ranked(documents_index(spark, sf_dir).search(TOKENS, 10), "score")
    field = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    docs = search.hydrate(hits.select("doc_id", "rank"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id", "doc_id", "row_")
    rows = docs.select("rank", F.col("doc_id").cast("string").alias("rowid"), (1.0 / (F.col("rank") + 1)).alias("similarity"), F.array(field("lang", F.col("row_lang")), field("n_chars", F.col("row_n_chars"))).alias("fields"), F.col("row_source").alias("source"))
    out = [context.build(rows, Settings(row_format=fmt, context_tokens=60), "S").select(F.lit(fmt).alias("format"), F.sha2("context", 256).alias("context_sha256"), F.col("n").cast("long").alias("n"), F.size("citations").cast("long").alias("citations")) for fmt in context.FORMATS]
    return out[0].unionByName(out[1]).unionByName(out[2])


CONTEXT_BUILD = f"""
WITH {_BM25},
h AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 10),
t AS (SELECT h.rank, 1.0 / (h.rank + 1) AS sim, coalesce(lang, 'None') AS l, coalesce(CAST(n_chars AS VARCHAR), 'None') AS c FROM h JOIN documents USING (doc_id)),
f AS (
  SELECT rank, 'markdown_table' AS format, '| [' || rank || '] | ' || l || ' | ' || c || ' |' AS row FROM t
  UNION ALL SELECT rank, 'json', '  {{' || chr(10) || '    "_ref": ' || rank || ',' || chr(10) || '    "similarity": ' || CAST(CAST(round(sim, 3) AS DOUBLE) AS VARCHAR) || ',' || chr(10) || '    "lang": ' || to_json(l) || ',' || chr(10) || '    "n_chars": ' || to_json(c) || chr(10) || '  }}' FROM t
  UNION ALL SELECT rank, 'key_value', '[' || rank || '] Similarity=' || printf('%.2f', CAST(sim AS DOUBLE)) || chr(10) || '  lang: ' || l || chr(10) || '  n_chars: ' || c FROM t
), b AS (SELECT * FROM (SELECT *, sum(length(row)) OVER (PARTITION BY format ORDER BY rank) AS used FROM f) WHERE used <= 240),
g AS (
  SELECT format, count(*) AS n, CASE format WHEN 'markdown_table' THEN '| # | lang | n_chars |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(row, chr(10) ORDER BY rank)
    WHEN 'json' THEN '```json' || chr(10) || '[' || chr(10) || string_agg(row, ',' || chr(10) ORDER BY rank) || chr(10) || ']' || chr(10) || '```' ELSE string_agg(row, chr(10) || chr(10) ORDER BY rank) END AS body
  FROM b GROUP BY format
)
SELECT format, sha256('### Database Schema Summary' || chr(10) || 'S' || chr(10) || chr(10) || '### Retrieved Records (' || n || ' rows, ranked by relevance)' || chr(10) || chr(10) || body || chr(10) || chr(10) || chr(10) || '*Retrieved ' || n || ' of ' || (SELECT count(*) FROM h) || ' candidate rows (similarity threshold applied).*') AS context_sha256,
       n, n AS citations FROM g
"""


def output_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as an answer, with its conversation's role as the only source text."""
    turns = table(spark, sf_dir, "conversations")
    checked = turns.select("conv_id", "turn", guards.check_output(F.coalesce("text", F.lit("")), F.array("role")).alias("g"))
    return checked.select("conv_id", "turn", "g.safe", F.array_join("g.warnings", "; ").alias("warnings"))


OUTPUT_GUARD = r"""
WITH n AS (
  SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(coalesce(text, ''), '\b\d{2,}\b')),
    lambda x: coalesce(NOT (TRY_CAST(x AS HUGEINT) BETWEEN 1900 AND 2100) AND TRY_CAST(x AS HUGEINT) > 10, true))) AS k FROM conversations
)
SELECT conv_id, turn, k <= 3 AS safe, CASE WHEN k > 3 THEN 'Response contains ' || k || ' numbers not found in retrieved data' ELSE '' END AS warnings FROM n
"""


def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncated(F.col("text"), 200).alias("short"))


TRUNCATE_TEXT = "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 199) || '…' END AS short FROM documents"


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation that fit a context of 2,000 characters, from the first on."""
    turns = table(spark, sf_dir, "conversations")
    fit = context.within_budget(turns, F.coalesce(F.length("text"), F.lit(0)), ["conv_id"], "turn", 2000)
    return fit.select("conv_id", "turn", F.col("used").cast("long").alias("used"))


CONTEXT_BUDGET = """
WITH s AS (SELECT conv_id, turn, CAST(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations)
SELECT * FROM s WHERE used <= 2000
"""


def embed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed embeddings of all whole texts: places, filled ones, and a sum that weighs each place by its number."""
    rows = table(spark, sf_dir, "documents").select("doc_id", vx.embedder()(F.col("text")).alias("e"))
    weighed = F.aggregate(F.transform("e", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", F.size("e").cast("long").alias("dim"), F.size(F.filter("e", lambda x: x != 0)).cast("long").alias("filled"), F.round(weighed, 4).alias("weighed"))


EMBED_ROWS = r"""
WITH tab AS (SELECT list(list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY x) AS tab FROM range(256) r(x)),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS word FROM documents),
h AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, 2 * octet_length(encode(word)), 2), lambda i: CAST('0x' || substr(hex(encode(word)), i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT word FROM w), tab
), e AS (SELECT doc_id, crc % 64 AS place, sum(CASE WHEN crc & 65536 > 0 THEN 1 ELSE -1 END) AS x FROM w JOIN h USING (word) GROUP BY ALL),
n AS (SELECT doc_id, CAST(sqrt(sum(x * x)) AS FLOAT) AS norm FROM e GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS filled, sum((place + 1) * CAST(CAST(x AS FLOAT) / norm AS DOUBLE) ORDER BY place) AS weighed FROM e JOIN n USING (doc_id) WHERE x <> 0 GROUP BY doc_id)
SELECT doc_id, CAST(64 AS BIGINT) AS dim, coalesce(filled, 0) AS filled, round(coalesce(weighed, 0.0), 4) AS weighed FROM documents LEFT JOIN s USING (doc_id)
"""

QUERIES = {
    "vector_topk": (vector_topk, VECTOR_TOPK),
    "vector_topk_batch": (vector_topk_batch, VECTOR_TOPK_BATCH),
    "vector_index_topk": (vector_index_topk, VECTOR_INDEX_TOPK),
    "semantic_cache_hit": (semantic_cache_hit, SEMANTIC_CACHE_HIT),
    "semantic_cache_get": (semantic_cache_get, SEMANTIC_CACHE_GET),
    "bm25_topk": (bm25_topk, BM25_TOPK),
    "bm25_batch": (bm25_batch, BM25_BATCH),
    "rrf_fuse": (rrf_fuse, RRF_FUSE),
    "hybrid_lookup": (hybrid_lookup, HYBRID_LOOKUP),
    "rerank_topn": (rerank_topn, RERANK_TOPN),
    "pii_detect": (pii_detect, PII_DETECT),
    "pii_redact": (pii_redact, PII_REDACT),
    "injection_detect": (injection_detect, INJECTION_DETECT),
    "input_guard": (input_guard, INPUT_GUARD),
    "number_hallucination": (number_hallucination, NUMBER_HALLUCINATION),
    "query_rewrite": (query_rewrite, QUERY_REWRITE),
    "cache_keys": (cache_keys, CACHE_KEYS),
    "response_cache": (response_cache, RESPONSE_CACHE),
    "response_cache_full": (response_cache_full, RESPONSE_CACHE_FULL),
    "output_guard": (output_guard, OUTPUT_GUARD),
    "output_guard_sources": (output_guard_sources, OUTPUT_GUARD_SOURCES),
    "context_rows": (context_rows, CONTEXT_ROWS),
    "context_build": (context_build, CONTEXT_BUILD),
    "truncate_text": (truncate_text, TRUNCATE_TEXT),
    "context_budget": (context_budget, CONTEXT_BUDGET),
    "embed_rows": (embed_rows, EMBED_ROWS),
}
