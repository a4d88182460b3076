"""The vector collection: entries (id, embedding, document, metadata) in
Parquet under one folder, as numbered versions (``sources.commits``).

A version is a list of *layers*: a base, dealt into buckets by a hash of the id,
and deltas on top, each the entries that one change brought and the ids that it
took out (``gone``). A change writes its own rows and nothing else; a read takes
of each id what the newest layer says. ``tidy`` merges deltas of like size, so
few are read however many changes there were, and makes a new base when they
have grown to a fair part of it; a new base has as many buckets as its size
wants. ``clean_up`` deletes what no kept version names.

Of two writers that began with the same version both succeed if no id is in
both changes; else the second fails and must begin anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as tx
from weftline.model import COLLECTION, Strategy
from weftline.sources.commits import Commits, OtherWriter

__all__ = ["COLLECTION", "Collection", "OtherWriter"]

#: Buckets of a new base at least; bytes of a bucket on average at most.
BUCKETS, BUCKET_BYTES = 64, 256 << 20
#: Deltas up to which nothing is merged; share of the base's bytes from which on deltas go into it.
DELTAS, SHARE = 8, 0.25
DELTA = T.StructType([*COLLECTION.fields, T.StructField("gone", T.BooleanType())])
EMPTY = {"layers": [], "tags": {}}


class Collection(Commits):
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES):
        super().__init__(spark, folder)
        self.buckets, self.bucket_bytes = buckets, bucket_bytes

    def version(self) -> int | None:
        """The newest committed version."""
        return self.newest()

    def manifest(self, version: int | None = None) -> tuple[int | None, dict]:
        number = self.newest() if version is None else version
        return number, EMPTY if number is None else self.content(number)

    # --- reading --------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The entries of a version (the newest)."""
        return self._entries(self.manifest(version)[1])

    def pages(self) -> list[str]:
        """The pages of the newest version: its base's buckets, in order."""
        layers = self.manifest()[1]["layers"]
        return [str(k) for k in range(self._page_count(layers))] if layers else []

    def page(self, number: str | int, with_embedding: bool = False) -> DataFrame:
        """The entries of one page, without their vectors if those aren't asked for; an unknown page is empty."""
        rows = self._entries(self.manifest()[1], page=int(number) if str(number).isdigit() else -1)
        return rows if with_embedding else rows.drop("embedding")

    def _page_count(self, layers: list[dict]) -> int:
        return next((x["buckets"] for x in layers if x["kind"] == "base"), self.buckets)

    def _layer(self, layer: dict, page: int | None, buckets: int) -> DataFrame:
        """The rows of a layer; of a page only its bucket's folder is listed, or the rows whose id falls into it."""
        if layer["kind"] == "base":
            rows = self.spark.read.schema(T.StructType([*COLLECTION.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.folder}/{layer['name']}")
            return (rows if page is None else rows.filter(F.col("bucket") == page)).drop("bucket")
        rows = self.spark.read.schema(DELTA).parquet(f"{self.folder}/{layer['name']}")
        return rows if page is None else rows.filter(self._bucket(buckets) == page)

    def _entries(self, was: dict, page: int | None = None) -> DataFrame:
        buckets = self._page_count(was["layers"])
        base = [self._layer(x, page, buckets) for x in was["layers"] if x["kind"] == "base"]
        deltas = [x for x in was["layers"] if x["kind"] == "delta"]
        if not deltas:
            return base[0] if base else self.spark.createDataFrame([], COLLECTION)
        newest = self._newest(deltas, page, buckets)
        live = newest.filter("not gone").drop("gone")
        if not base:
            return live
        # only the ids of the deltas meet the base, which stays where it is as long as they can be broadcast
        touched = reduce(DataFrame.unionByName, [self._layer(x, page, buckets).select("id") for x in deltas])
        return base[0].join(touched, "id", "left_anti").select(*COLLECTION.names).unionByName(live)

    def _newest(self, deltas: list[dict], page: int | None, buckets: int) -> DataFrame:
        """Of each id of some deltas the row of the newest."""
        if len(deltas) == 1:
            return self._layer(deltas[0], page, buckets)
        rows = reduce(DataFrame.unionByName, [self._layer(x, page, buckets).withColumn("_at", F.lit(x["at"])) for x in deltas])
        return rows.groupBy("id").agg(F.max_by(F.struct(*DELTA.names[1:]), "_at").alias("r")).select("id", "r.*")

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")

    # --- writing --------------------------------------------------------------------

    def _base(self, entries: DataFrame, buckets: int) -> dict:
        name = self.fresh_folder("v")
        rows = entries.select(*COLLECTION.names).withColumn("bucket", self._bucket(buckets))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return {"name": name, "kind": "base", "buckets": buckets, "bytes": self.size(name)}

    def _delta(self, rows: DataFrame) -> dict:
        name = self.fresh_folder("v")
        rows.select(*DELTA.names).write.parquet(f"{self.folder}/{name}")
        return {"name": name, "kind": "delta", "bytes": self.size(name)}

    def replace(self, entries: DataFrame) -> int:
        """Commit these entries as the whole collection."""
        number, was = self.manifest()
        layer = self._base(entries, self._page_count(was["layers"]))
        after = 0 if number is None else number + 1
        return self.add(after, {"op": "replace", "layers": [dict(layer, at=after)], "tags": was["tags"]})

    def change(self, entries: DataFrame | None = None, gone: DataFrame | None = None, tag: tuple[str, int] | None = None) -> int | None:
        """Delete the ids ``gone`` and upsert ``entries`` (of rows with one id the
        first). ``tag``: a name and a growing number; a change whose number the
        collection has already under that name is not made again."""
        number, was = self.manifest()
        if tag and was["tags"].get(tag[0], -1) >= tag[1]:
            return number
        parts = []
        if entries is not None:
            at = entries.withColumn("_at", F.monotonically_increasing_id())
            parts.append(first_of_each(at, "id", ["_at", "document"]).select(*COLLECTION.names, F.lit(False).alias("gone")))
        if gone is not None:
            ids = gone.select("id").distinct()
            ids = ids if entries is None else ids.join(entries.select("id"), "id", "left_anti")
            parts.append(ids.select("id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in COLLECTION.fields[1:]], F.lit(True).alias("gone")))
        layer = self._delta(reduce(DataFrame.unionByName, parts))
        began = -1 if number is None else number
        while True:
            after = 0 if number is None else number + 1
            tags = dict(was["tags"], **({tag[0]: tag[1]} if tag else {}))
            try:
                return self.add(after, {"op": "change", "layers": [*was["layers"], dict(layer, at=after)], "tags": tags})
            except OtherWriter:  # go after the other's change, if it is of other ids
                number, was = self.manifest(self.newest())
                self._check_apart(layer, began, number)

    def _check_apart(self, layer: dict, began: int, number: int) -> None:
        ids = self._layer(layer, None, 0).select("id")
        for k in range(began + 1, number + 1):
            other = self.content(k)
            if other["op"] == "replace":
                raise OtherWriter(f"version {k} replaced the collection")
            theirs = [x for x in other["layers"] if x["at"] == k and x["kind"] == "delta"] if other["op"] == "change" else []
            if any(not self._layer(x, None, 0).select("id").join(ids, "id", "left_semi").isEmpty() for x in theirs):
                raise OtherWriter(f"version {k} changed some of the same ids")

    def upsert(self, entries: DataFrame) -> int | None:
        return self.change(entries)

    def delete(self, ids: DataFrame) -> int | None:
        return self.change(gone=ids)

    def tidy(self) -> int | None:
        """Merge what has gathered, if there is enough: the newest deltas of like
        size into one, or all into a new base. Another writer's change meanwhile
        leaves all as it is; a later call finds it."""
        number, was = self.manifest()
        base = [x for x in was["layers"] if x["kind"] == "base"]
        deltas = [x for x in was["layers"] if x["kind"] == "delta"]
        if base and deltas and sum(x["bytes"] for x in deltas) > SHARE * base[0]["bytes"] or not base and len(deltas) > DELTAS:
            return self.compact()
        if len(deltas) <= DELTAS:
            return number
        first, newer = len(deltas) - 1, deltas[-1]["bytes"]
        while first and deltas[first - 1]["bytes"] <= 2 * newer:
            first, newer = first - 1, newer + deltas[first - 1]["bytes"]
        merged = dict(self._delta(self._newest(deltas[first:], None, 0)), at=deltas[-1]["at"])
        return self._put(number, {"op": "merge", "layers": [*base, *deltas[:first], merged], "tags": was["tags"]})

    def compact(self) -> int | None:
        """A new base of all that counts, its buckets doubled until they are small enough."""
        number, was = self.manifest()
        if number is None:
            return None
        buckets = self._page_count(was["layers"])
        while sum(x["bytes"] for x in was["layers"]) > buckets * self.bucket_bytes:
            buckets *= 2
        layer = self._base(self._entries(was), buckets)
        return self._put(number, {"op": "merge", "layers": [dict(layer, at=number)], "tags": was["tags"]})

    def _put(self, number: int, content: dict) -> int:
        try:
            return self.add(number + 1, content)
        except OtherWriter:
            return number

    def clean_up(self, keep: int = 1) -> list[str]:
        """Delete versions but the newest ``keep`` and the layers that only those named."""
        kept = [self.content(n) for n in self.numbers()[-keep:]]
        return self.clean(keep, {x["name"] for c in kept for x in c["layers"]}, ("v",))


def first_of_each(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each key; ties in the order are settled by the caller's columns."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, arrival: str | None = None) -> DataFrame:
    """Old entries whose id isn't new, and of each new id the entry that came
    first: by the column ``arrival``, or in the order in which they are read."""
    at = new.withColumn("_at", F.col(arrival) if arrival else F.monotonically_increasing_id())
    own = first_of_each(at, "id", ["_at", "document"]).select("id", "embedding", "document", "metadata")
    return old.join(own.select("id"), "id", "left_anti").select("id", "embedding", "document", "metadata").unionByName(own)


def entries(df: DataFrame, strategy: Strategy, embed, source: str, table: str) -> DataFrame:
    """Collection entries of a table's rows: text and vector stay in one row, so nothing is joined."""
    rowid = F.col(strategy.rowid_col).cast("string")
    meta = F.create_map(F.lit("rowid"), rowid, F.lit("source"), F.lit(source), F.lit("table_or_sheet"), F.lit(table))
    texts = df.select(rowid.alias("id"), tx.serialize(df, strategy).alias("document"), meta.alias("metadata"))
    return texts.select("id", embed(F.col("document")).alias("embedding"), "document", "metadata")


def unprocessed(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows still to do, by key as text; rows with a null key have no identity and stay out."""
    done = processed.select(F.col("row_id").cast("string").alias("_key"))
    return rows.filter(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string")).join(done, "_key", "left_anti").drop("_key")


def append_new(target: DataFrame, rows: DataFrame, key: str = "__orig_rowid__", order: list[Column | str] | None = None) -> DataFrame:
    """The rows whose key the target lacks, one of each key: what an insert that
    does nothing on conflict adds."""
    first = first_of_each(rows, key, order or [F.xxhash64(*rows.columns)])
    return first.join(target.select(key), key, "left_anti").select(*rows.columns)


def collection_stats(collection: DataFrame) -> DataFrame:
    """total_entries, has_documents (any entry has one), with_embedding."""
    return collection.agg(F.count(F.lit(1)).alias("total_entries"), F.coalesce(F.bool_or(F.col("document").isNotNull()), F.lit(False)).alias("has_documents"), F.count("embedding").alias("with_embedding"))


def progress(processed: DataFrame) -> DataFrame:
    """processed, last_row (the greatest row_id) and rows_written of processed
    entries (row_id, rows_written); zeros where there are none."""
    zero = F.lit(0).cast("long")
    return processed.agg(F.count("row_id").alias("processed"), F.coalesce(F.max("row_id").cast("long"), zero).alias("last_row"), F.coalesce(F.sum("rows_written").cast("long"), zero).alias("rows_written"))


def chunk_status(log: DataFrame) -> DataFrame:
    """Newest status of every chunk of an append-only manifest (chunk_id, status, at), counted."""
    newest = log.groupBy("chunk_id").agg(F.max_by("status", "at").alias("status"))
    return newest.groupBy("status").agg(F.count(F.lit(1)).alias("chunks"))


#: What may follow a chunk's status; a chunk that has none is pending.
NEXT = {"pending": ("running",), "running": ("done", "failed", "pending"), "failed": ("running",), "done": ()}


def chunk_states(log: DataFrame) -> DataFrame:
    """chunk_id, status (the newest), attempts (times it began) and error (of the
    newest failure) of an append-only manifest (chunk_id, status, at, error)."""
    return log.groupBy("chunk_id").agg(F.max_by("status", "at").alias("status"), F.count_if(F.col("status") == "running").alias("attempts"), F.max_by("error", F.when(F.col("status") == "failed", F.col("at"))).alias("error"))


def moved(log: DataFrame, chunks: DataFrame, status: str, at: Column, error: Column | None = None) -> DataFrame:
    """The rows to append so that these chunks (chunk_id) get a status; chunks
    for which it may not follow get none."""
    now = chunks.select("chunk_id").distinct().join(chunk_states(log).select("chunk_id", F.col("status").alias("was")), "chunk_id", "left")
    legal = [k for k, v in NEXT.items() if status in v]
    good = F.coalesce("was", F.lit("pending")).isin(legal) if legal else F.lit(False)
    return now.filter(good).select("chunk_id", F.lit(status).alias("status"), at.alias("at"), (F.lit(None) if error is None else error).cast("string").alias("error"))


def failed_chunks(log: DataFrame) -> DataFrame:
    """chunk_id, attempts, error of the chunks that stand failed."""
    return chunk_states(log).filter("status = 'failed'").drop("status")


def to_retry(log: DataFrame, most: int = 3) -> DataFrame:
    """Failed chunks that began fewer than ``most`` times."""
    return failed_chunks(log).filter(F.col("attempts") < most)


def reset(log: DataFrame, at: Column) -> DataFrame:
    """The rows to append after a lost run: running chunks are pending again."""
    return moved(log, chunk_states(log).filter("status = 'running'"), "pending", at)
