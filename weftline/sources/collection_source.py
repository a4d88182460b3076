"""The collection as a data source: ``spark.read.format("weftline_collection")``.

Options: ``path``; ``version`` (the newest by default); ``changes`` (true: rows with
``gone`` and ``version`` as changes brought them; needed for streams). A batch read
has a partition for each page, and reads of a page what its bucket's files and the
deltas say, newest first; ``id = ...`` and ``id in (...)`` leave only those ids' pages
(with spark.sql.python.filterPushdown.enabled). A stream's offsets are versions: each
commit's rows come once, a replaced collection as a whole; merges bring nothing.
Files are read by pyarrow in the tasks, columns that Spark doesn't ask for included;
``Collection.read`` is the faster way where Spark's own reader will do."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

ENTRIES = "id string, embedding array<float>, document string, metadata map<string, string>"
CHANGES = f"{ENTRIES}, gone boolean, version long"
COLUMNS = ["id", "embedding", "document", "metadata"]


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named by a URI or an absolute path."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder.rstrip("/"))


def page_of(key: str, pages: int) -> int:
    """The page of an id, as Spark's own hash deals it."""
    value = xxhash.xxh64_intdigest(key.encode(), seed=42)
    return (value - (1 << 64) if value >> 63 else value) % pages


class _Folder:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("weftline_collection needs the option path")
        self.system, self.path = filesystem(options["path"])

    def numbers(self) -> list[int]:
        found = self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(int(f.base_name.removeprefix("commit-")) for f in found if f.base_name.startswith("commit-"))

    def content(self, number: int) -> dict:
        with self.system.open_input_file(f"{self.path}/commit-{number:012d}") as file:
            return json.loads(file.readall())

    def table(self, name: str, columns: list[str]) -> pa.Table:
        info = self.system.get_file_info(f"{self.path}/{name}")
        if info.type == fs.FileType.NotFound:
            return pa.table({c: pa.array([], pa.string()) for c in columns})
        return ds.dataset(f"{self.path}/{name}", filesystem=self.system, format="parquet", partitioning=None).to_table(columns=columns)


class _Page(InputPartition):
    def __init__(self, number: int, pages: int, base: str | None, deltas: list[str]):
        super().__init__(number)
        self.number, self.pages, self.base, self.deltas = number, pages, base, deltas


class _Layer(InputPartition):
    def __init__(self, name: str, version: int, kind: str):
        super().__init__(name)
        self.name, self.version, self.kind = name, version, kind


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.list_(pa.float32()), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.int64()]
    names = [*COLUMNS, "gone", "version"][: table.num_columns]
    for batch in table.to_batches(max_chunksize=4096):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(n).cast(k) for n, k in zip(names, kinds, strict=False)], names)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.ids = options, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = own if self.ids is None else self.ids & own
            yield f  # a page holds other ids too, so Spark filters again

    def partitions(self):
        folder = _Folder(self.options)
        numbers = folder.numbers()
        if not numbers:
            return []
        layers = folder.content(int(self.options.get("version", numbers[-1])))["layers"]
        base = next((x for x in layers if x["kind"] == "base"), None)
        pages = base["buckets"] if base else 1
        deltas = [x["name"] for x in layers if x["kind"] == "delta"]
        some = range(pages) if self.ids is None else sorted({page_of(k, pages) for k in self.ids if k is not None})
        return [_Page(k, pages, f"{base['name']}/bucket={k}" if base else None, deltas) for k in some]

    def read(self, page):
        if page is None:  # no partition at all
            return
        folder = _Folder(self.options)
        seen: set[str] = set()
        for name in reversed(page.deltas):
            rows = folder.table(name, [*COLUMNS, "gone"])
            ids = rows.column("id").to_pylist()
            own = [k for k, i in enumerate(ids) if page_of(i, page.pages) == page.number and i not in seen]
            seen.update(ids[k] for k in own)
            live = rows.take(pa.array(own, pa.int64()))
            yield from _batches(live.filter(pc.invert(live.column("gone"))).select(COLUMNS)) if len(own) else ()
        if page.base:
            rows = folder.table(page.base, COLUMNS)
            yield from _batches(rows.filter(pc.invert(pc.is_in(rows.column("id"), pa.array(sorted(seen), pa.string())))) if seen else rows)


def _changed(folder: _Folder, after: int, upto: int) -> list[_Layer]:
    out = []
    known = set(folder.numbers())
    for number in range(after + 1, upto + 1):
        if number not in known:
            raise ValueError(f"version {number} was cleaned up before it was read")
        was = folder.content(number)
        if was["op"] != "merge":
            out += [_Layer(x["name"], number, x["kind"]) for x in was["layers"] if x["at"] == number]
    return out


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {"version": int(self.options.get("version", -1))}

    def latestOffset(self):
        return {"version": max(_Folder(self.options).numbers(), default=-1)}

    def partitions(self, start, end):
        return _changed(_Folder(self.options), start["version"], end["version"])

    def read(self, layer):
        yield from _layer(_Folder(self.options), layer) if layer else ()

    def commit(self, end):
        pass


def _layer(folder: _Folder, layer: _Layer) -> Iterator[pa.RecordBatch]:
    rows = folder.table(layer.name, [*COLUMNS, *(["gone"] if layer.kind == "delta" else [])])
    if layer.kind == "base":
        rows = rows.append_column("gone", pa.array([False] * rows.num_rows, pa.bool_()))
    yield from _batches(rows.append_column("version", pa.array([layer.version] * rows.num_rows, pa.int64())))


class _Changes(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        folder = _Folder(self.options)
        return _changed(folder, int(self.options.get("version", -1)), max(folder.numbers(), default=-1))

    def read(self, layer):
        yield from _layer(_Folder(self.options), layer) if layer else ()


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline_collection"

    def _changes(self) -> bool:
        return self.options.get("changes", "false").lower() == "true"

    def schema(self):
        return CHANGES if self._changes() else ENTRIES

    def reader(self, schema):
        return _Changes(dict(self.options)) if self._changes() else _Batch(dict(self.options))

    def streamReader(self, schema):
        if not self._changes():
            raise ValueError("a stream needs the option changes")
        return _Stream(dict(self.options))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CollectionSource)
