"""A stored inverted index for BM25: searched by term, kept up by upserts and deletes.

A version is a list of *segments*, each the packed postings (``operators.keywords``)
of the documents that one commit brought, and of *tombstones*, the ids that a
commit took out of all segments before it. Postings lie in folders by a hash of
their term, sorted by term, so a search reads the folders of its terms and of
those the row groups that hold them. An upsert writes its own documents' postings
and their ids, a delete writes ids; neither touches what is there. ``compact``
makes one segment of what still counts, ``clean`` deletes what no kept version
names.

An id is one document: of rows with one id in an upsert all stay in the index,
and all go together. Rows without an id take no part. Null and empty texts count
as documents of length 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import keywords as kw
from weftline.operators.search import written
from weftline.sources.commits import Commits, OtherWriter

#: Folders by term of a new segment; pages that one task writes of such a folder.
BUCKETS, PAGES = 32, 256
#: Pages scored first in a search, for a score that others must beat; pages below which all are scored at once.
FIRST_PAGES = 16
#: Bytes of tombstone ids up to which they are broadcast.
BROADCAST = 32 << 20
EMPTY = {"id": None, "docs": 0, "tokens": 0, "segments": [], "tombstones": []}


class TextIndex(Commits):
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, page_docs: int | None = None):
        super().__init__(spark, folder)
        self.buckets, self.page_docs = buckets, page_docs

    def manifest(self) -> tuple[int | None, dict]:
        number = self.newest()
        return number, EMPTY if number is None else self.content(number)

    # --- changes ------------------------------------------------------------------

    def upsert(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> int:
        """Add documents; those whose ids the index has already are replaced."""
        kind = self.manifest()[1]["id"] or docs.schema[id_col].dataType.simpleString()
        segment = self._write(kw.packed(docs.withColumn(id_col, F.col(id_col).cast(kind)), id_col, text, page_docs=self.page_docs))
        for _ in range(20):
            number, was = self.manifest()
            after = 0 if number is None else number + 1
            now = dict(was, id=kind)
            if was["segments"]:
                ids = self.spark.read.parquet(f"{self.folder}/{segment['name']}/docs").select("id").distinct()
                now = self._without(now, ids, after)
            own = dict(segment, at=after)
            now = dict(now, docs=now["docs"] + own["docs"], tokens=now["tokens"] + own["tokens"], segments=[*now["segments"], own])
            try:
                return self.add(after, now)
            except OtherWriter:  # begin anew after the other's version
                continue
        raise OtherWriter("other writers were always faster")

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> int | None:
        """Take documents out by their ids; ids that aren't there change nothing."""
        for _ in range(20):
            number, was = self.manifest()
            if number is None:
                return None
            gone = ids.select(F.col(id_col).cast(was["id"]).alias("id")).filter("id is not null").distinct()
            try:
                return self.add(number + 1, self._without(was, gone, number + 1))
            except OtherWriter:
                continue
        raise OtherWriter("other writers were always faster")

    def compact(self) -> int | None:
        """One segment of all documents that count. Needs no texts."""
        number, was = self.manifest()
        if number is None or (len(was["segments"]) < 2 and not was["tombstones"]):
            return number
        blocks = self._alive(self._all_blocks(was), was)
        # pages get new numbers, for those of another segment added later would meet the old ones
        pages = written(blocks.select("page").distinct().withColumn("_new", F.monotonically_increasing_id()))
        blocks = blocks.join(pages, "page").drop("page").withColumnRenamed("_new", "page")
        segment = dict(self._write(blocks), at=number + 1)
        return self.add(number + 1, dict(was, segments=[segment] if segment["docs"] else [], tombstones=[]))

    def clean_up(self, keep: int = 1) -> list[str]:
        kept = [self.content(n) for n in self.numbers()[-keep:]]
        named = {x["name"] for c in kept for x in [*c["segments"], *c["tombstones"]]}
        return self.clean(keep, named, ("segment", "tombstones"))

    def _without(self, was: dict, ids: DataFrame, at: int) -> dict:
        """The manifest after these ids (distinct) went from all its segments."""
        name = self.fresh_folder("tombstones")
        ids.select("id").write.parquet(f"{self.folder}/{name}")
        gone = self.spark.read.parquet(f"{self.folder}/{name}")
        lost = self.documents(was).join(gone, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).first()
        if not lost["n"]:
            return was
        tombstone = {"name": name, "at": at, "bytes": self.size(name)}
        return dict(was, docs=was["docs"] - lost["n"], tokens=was["tokens"] - (lost["tokens"] or 0), tombstones=[*was["tombstones"], tombstone])

    def _write(self, blocks: DataFrame) -> dict:
        """Write blocks as a segment: postings by term, and the documents' ids and lengths."""
        name = self.fresh_folder("segment")
        blocks = written(blocks)
        pages = blocks.filter("term is null")
        counted = pages.agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("tokens")).first()
        salts = max(1, -(-counted["pages"] // PAGES))
        tasks = min(self.buckets * salts, max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        rows = blocks.filter("term is not null").withColumn("bucket", self._bucket(F.col("term"), self.buckets))
        # a frequent term's blocks are dealt over as many tasks as they fill
        rows = rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("page"), F.lit(salts))).sortWithinPartitions("bucket", "term", "page")
        rows.write.partitionBy("bucket").parquet(f"{self.folder}/{name}/postings")
        pages.select("page", F.explode(F.arrays_zip("ids", "lengths")).alias("d")).select("page", F.col("d.ids").alias("id"), F.col("d.lengths").alias("length")).write.parquet(f"{self.folder}/{name}/docs")
        return {"name": name, "buckets": self.buckets, "docs": counted["docs"] or 0, "tokens": counted["tokens"] or 0}

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    # --- reading --------------------------------------------------------------------

    def _id_type(self, was: dict) -> T.DataType:
        return T.DataType.fromDDL(was["id"] or "bigint")

    def documents(self, was: dict | None = None) -> DataFrame:
        """id and length of the documents of a version (the newest)."""
        was = was or self.manifest()[1]
        kind = T.StructType([T.StructField("page", T.LongType()), T.StructField("id", self._id_type(was)), T.StructField("length", T.IntegerType())])
        parts = [self.spark.read.schema(kind).parquet(f"{self.folder}/{x['name']}/docs").withColumn("_at", F.lit(x["at"])) for x in was["segments"]]
        return self._alive(self._union(parts, kind), was, flat=True).select("id", "length")

    def _union(self, parts: list[DataFrame], kind: T.StructType) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], kind).withColumn("_at", F.lit(0))

    def _all_blocks(self, was: dict, terms: DataFrame | list[str] | None = None) -> DataFrame:
        """The blocks of the segments, with the segment's commit as ``_at``; of some
        terms only their folders are listed, and the terms reach the scan. Without
        terms also each page's row of all its documents. Pages of different
        segments get different numbers."""
        schema = kw.blocks_type(self._id_type(was))
        stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        parts = []
        for k, segment in enumerate(was["segments"]):
            rows = self.spark.read.schema(stored).parquet(f"{self.folder}/{segment['name']}/postings")
            if isinstance(terms, list):
                rows = rows.filter(F.col("bucket").isin(self._buckets_of(terms, segment["buckets"])) & F.col("term").isin(terms))
            elif terms is not None:
                own = [r["b"] for r in terms.select(self._bucket(F.col("term"), segment["buckets"]).alias("b")).distinct().collect()]
                rows = rows.filter(F.col("bucket").isin(own)).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
            own_page = (F.col("page") + F.lit(k << 52)).alias("page")
            parts.append(rows.select("term", own_page, *[c for c in schema.names if c not in ("term", "page")], F.lit(segment["at"]).alias("_at")))
            if terms is None:
                parts.append(self._page_rows(segment, k))
        return self._union(parts, schema)

    def _page_rows(self, segment: dict, k: int) -> DataFrame:
        """The rows without a term, from the documents (a page holds a bounded number)."""
        docs = self.spark.read.parquet(f"{self.folder}/{segment['name']}/docs").withColumn("page", F.col("page") + F.lit(k << 52))
        rows = docs.groupBy("page").agg(F.collect_list(F.struct("id", "length")).alias("d"))
        size = F.size("d")
        places = F.transform(F.sequence(F.lit(1), size), lambda i: i - 1)
        return rows.select(
            F.lit(None).cast("string").alias("term"), "page", size.alias("n"), F.lit(0).alias("max_tf"), F.lit(0).alias("min_length"),
            F.col("d.id").alias("ids"), places.alias("places"), F.transform("d", lambda x: F.lit(0)).alias("tf"), F.col("d.length").alias("lengths"), F.lit(segment["at"]).alias("_at"),
        )

    def _buckets_of(self, terms: list[str], buckets: int) -> list[int]:
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term"), buckets).alias("b")).distinct().collect()
        return [r["b"] for r in rows]

    def _alive(self, rows: DataFrame, was: dict, flat: bool = False) -> DataFrame:
        """Rows less what later tombstones took: of documents (flat) rows, of blocks entries."""
        if not was["tombstones"]:
            return rows
        dead = None
        for t in was["tombstones"]:
            one = self.spark.read.parquet(f"{self.folder}/{t['name']}").select("id", F.lit(t["at"]).alias("_until"))
            dead = one if dead is None else dead.unionByName(one)
        dead = dead.groupBy("id").agg(F.max("_until").alias("_until"))
        if sum(t["bytes"] for t in was["tombstones"]) <= BROADCAST:
            dead = F.broadcast(dead)
        if flat:
            return rows.join(dead, "id", "left").filter(F.col("_until").isNull() | (F.col("_at") >= F.col("_until"))).drop("_until")
        entries = rows.select("term", "page", "_at", F.explode(F.arrays_zip("ids", "places", "tf", "lengths")).alias("p")).select("term", "page", "_at", F.col("p.ids").alias("id"), F.col("p.places").alias("places"), F.col("p.tf").alias("tf"), F.col("p.lengths").alias("lengths"))
        left = entries.join(dead, "id", "left").filter(F.col("_until").isNull() | (F.col("_at") >= F.col("_until")))
        again = left.groupBy("term", "page", "_at").agg(F.sort_array(F.collect_list(F.struct("places", "id", "tf", "lengths"))).alias("e"))
        return again.select(
            "term", "page", F.size("e").alias("n"), F.array_max("e.tf").alias("max_tf"), F.array_min("e.lengths").alias("min_length"),
            F.col("e.id").alias("ids"), F.col("e.places").alias("places"), F.col("e.tf").alias("tf"), F.col("e.lengths").alias("lengths"), "_at",
        )

    # --- searches ---------------------------------------------------------------------

    def blocks(self, terms: list[str]) -> DataFrame:
        """The live blocks of a short list of terms."""
        was = self.manifest()[1]
        return self._alive(self._all_blocks(was, terms), was)

    def search(self, query_tokens: list[str], k: int | None = 10, id_col: str = "doc_id", k1: float = 1.5, b: float = 0.75, first_pages: int = FIRST_PAGES) -> DataFrame:
        """id, score of the k documents with the greatest BM25 score (all with a
        query token, if k is None); a token that stands twice counts twice. Only
        the folders of the terms are read. A few pages that may score best are
        scored first; pages whose bound is under the k-th score then are let go."""
        was = self.manifest()[1]
        empty = self.spark.createDataFrame([], T.StructType([T.StructField(id_col, self._id_type(was)), T.StructField("score", T.DoubleType())]))
        if not query_tokens or not was["docs"]:
            return empty
        terms = list(dict.fromkeys(query_tokens))
        blocks = self._alive(self._all_blocks(was, terms), was)
        if was["tombstones"]:
            blocks = written(blocks)  # the entries of later searches come from here, joined with the tombstones once
        n, mean = was["docs"], was["tokens"] / was["docs"]
        df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        weights = {t: query_tokens.count(t) * kw.idf(n, df[t]) for t in terms if t in df}
        if not weights:
            return empty
        if k is not None:
            pages = kw.bounded(blocks, weights, mean, k1, b)
            best = pages.orderBy(F.desc("bound"), "page").limit(first_pages + 1).collect()
            if len(best) > first_pages:  # there are more pages than are scored at once
                some = kw.scored(blocks.filter(F.col("page").isin([r["page"] for r in best[:-1]])), weights, mean, k1, b)
                sure = some.select("score").orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
                if sure["n"] == k:
                    if best[-1]["bound"] < sure["least"] - 1e-6:  # no other page can
                        blocks = blocks.filter(F.col("page").isin([r["page"] for r in best[:-1]]))
                    else:
                        blocks = blocks.join(pages.filter(F.col("bound") >= sure["least"] - 1e-6), "page", "left_semi")
        found = kw.scored(blocks, weights, mean, k1, b).select(F.col("id").alias(id_col), "score")
        # sums differ in their last bits with the order of the terms: equal to six decimals is equal
        return found if k is None else found.orderBy(F.round("score", 6).desc(), F.asc(id_col)).limit(k)

    def search_batch(self, queries: DataFrame, k: int = 10, id_col: str = "doc_id", k1: float = 1.5, b: float = 0.75, room: int | None = None) -> DataFrame:
        """query_id, id, rank, score for each row of queries (query_id, text). A page's
        blocks meet in one task, which keeps k documents of every query in all."""
        was = self.manifest()[1]
        asked = written(kw.asked_terms(queries))
        kind = asked.schema["query_id"].dataType.simpleString()
        parts = []
        n, mean = was["docs"], was["tokens"] / max(was["docs"], 1)
        for rows in kw.query_parts(asked, room or kw.TERM_BYTES):
            if not rows or not n:
                continue
            terms = self.spark.createDataFrame([(t,) for t in sorted({r["term"] for r in rows})], "term string")
            blocks = self._alive(self._all_blocks(was, terms), was)
            blocks = written(kw.page_by_page(blocks.select("term", "page", "n", "ids", "places", "tf", "lengths")))
            df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
            pairs = sorted((r["term"], r["query_id"], r["times"] * kw.idf(n, df[r["term"]])) for r in rows if r["term"] in df)
            if pairs:
                parts.append(kw.batch_scores(blocks, pairs, mean, k, k1, b, kind))
        none = self.spark.createDataFrame([], f"query_id {kind}, id {self._id_type(was).simpleString()}, score double")
        return kw.ranked_batch(reduce(DataFrame.unionByName, parts, none), k, id_col)
