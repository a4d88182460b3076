"""Operator 11: token ids in seekable binary files.

Documents are encoded in ascending doc_id order and their ids written to files
of independent zstandard frames. A file, in order:

- *token frames*: ids of the file's documents one after the other, as unsigned
  little-endian integers of the file's width; ``FRAME_BYTES`` at most before
  compression, so a long document goes on in the next frame;
- *index frames*: for up to ``INDEX_DOCS`` documents each, doc_id (8 bytes
  signed), whether it is null (1 byte) and number of ids (8 bytes), as columns;
- a skippable frame with counts (``HEAD``);
- the *seek table* of zstandard's seekable format: a skippable frame with the
  compressed size, the size and a checksum (the lower 32 bits of XXH64) of
  every frame before it, and a footer that tells how many those are.

A reader takes the table from the file's end and decompresses only the frames
that hold what it wants, each checked against its checksum. Files are made by
Spark tasks under names of their own, and a table of the files that count
(``files``) is written when all are there, so files of lost or repeated
attempts are never read. Paths go through pyarrow's file systems.

Order: by doc_id, null ids last, ties by a hash of the text; rows that repeat
both stay and each has its place. Such rows, however many, are dealt over as
many files as they fill (a number in their partition tells them apart; for
that the rows of ``docs`` must come in the same order when a lost task is run
again, as those of a file scan do). Null and empty texts have their end id
only. An empty table gives no file. Columns besides ``doc_id`` and ``text``
are ignored. A text of any length is encoded whole; memory of a task grows with
its longest text (with ``words`` only by its ids).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exchange as X
from weftline.llm import words as W

#: Bytes of a token frame and documents of an index frame, before compression; bytes of text (and 16 a row) that go to a file.
FRAME_BYTES, INDEX_DOCS, FILE_BYTES = 1 << 18, 1 << 14, 96 << 20
LEVEL = 3
# Fixed values of the zstandard formats: magic numbers of the seek table's frame, of its footer and of the first skippable frame.
TABLE_MAGIC, FOOTER_MAGIC, SKIP_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
#: version, bytes of an id, token frames, index frames, documents, ids.
HEAD = struct.Struct("<HHIIQQ")
ENTRY, FOOTER, SKIP = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
#: Pieces of words, and their ids, that a worker remembers; bytes of text that are encoded at once.
KNOWN_PIECES, KNOWN_IDS, ENCODE_BYTES = 1 << 18, 1 << 21, 1 << 21
#: Marks that may stand behind the letters of a plain word.
MARKS = ".,;:!?&*$%#)"
#: Letters that are looked at one by one: the Latin ones of the first 256 code points.
LETTERS = [chr(c) for c in range(256) if chr(c).isalpha()]

FILES = "file int, path string, docs long, tokens long"


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named by a URI or an absolute path."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library (its JSON).

    ``words``: texts are taken apart at ASCII white space and each distinct word
    is encoded once while it is remembered. That gives the ids of the whole text
    if the tokenizer drops white space, joins nothing across it, and makes one
    piece of a run of Latin letters, whose form is that of its letters in a row,
    as word_bpe_49k does; for one that doesn't, leave it out. Letters and the marks
    after them are pieces of their own; runs of letters go straight to the
    tokenizer's model, all else through the whole tokenizer."""

    def __init__(self, tokenizer_json: str, words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.source, self.words = Tokenizer.from_str(tokenizer_json), tokenizer_json, words
        if words:
            self.model, self.forms = self.tokenizer.model, self._letter_forms()
            self.class_ = "".join(map(chr, self.forms))
            self.letters, self.plain = re.compile(f"[{self.class_}]+"), f"^[{self.class_}]+[{MARKS}]*$"
            self._forget()

    def _letter_forms(self) -> dict[int, str]:
        """The form in which the model gets each Latin letter, where that is one piece and its case doesn't matter."""
        before, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        out = {}
        for c in LETTERS:
            pieces = {tuple(p for p, _ in cut.pre_tokenize_str(before.normalize_str(x))) for x in (c, c.lower())}
            if len(pieces) == 1 and len(form := pieces.pop()) == 1:
                out[ord(c)] = form[0]
        return out

    def _forget(self) -> None:
        """Know the empty piece alone."""
        self.known = pa.array([""], pa.large_string())
        self.sizes, self.flat = array("q", [0]), array("I")

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """The number of each piece among the known; new ones are encoded first."""
        coded = pieces.dictionary_encode()
        found = pc.index_in(coded.dictionary, self.known)
        new = coded.dictionary.filter(found.is_null())
        if len(new):
            names = new.to_pylist()
            others = iter(self.tokenizer.encode_batch_fast([x for x in names if not self.letters.fullmatch(x)], add_special_tokens=False))
            for name in names:
                ids = [t.id for t in self.model.tokenize(name.translate(self.forms))] if self.letters.fullmatch(name) else next(others).ids
                self.sizes.append(len(ids))
                self.flat.extend(ids)
            self.known = pa.concat_arrays([self.known, new])
            found = pc.index_in(coded.dictionary, self.known)
        return np.asarray(found).astype(np.int64)[np.asarray(coded.indices)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.words:
            own = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *own]), np.array([len(x) for x in own], dtype=np.int64)
        if len(self.known) > KNOWN_PIECES or len(self.flat) > KNOWN_IDS:
            self._forget()
        runs = pc.ascii_split_whitespace(texts)
        per_text = np.asarray(runs.value_lengths()).astype(np.int64)
        coded = runs.flatten().dictionary_encode()
        word = coded.dictionary
        plain = pc.match_substring_regex(word, self.plain)
        # a plain word is its letters, without case, and the marks after them; another word is one piece
        piece = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(word, characters=MARKS)), word)
        marks = pc.if_else(plain, pc.replace_substring_regex(word, f"^[{self.class_}]+", ""), "")
        both = self._codes(pa.concat_arrays([piece, marks.cast(pa.large_string())])).reshape(2, -1)[:, np.asarray(coded.indices)].T.reshape(-1)
        size, flat = np.array(self.sizes, dtype=np.int64), np.array(self.flat, dtype=np.uint32)
        count = size[both]
        after = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(int(after[-1])) + np.repeat((np.cumsum(size) - size)[both] - after[:-1], count)
        edge = np.concatenate([[0], np.cumsum(2 * per_text)])
        return flat[place], np.diff(after[edge])


_HELD: list[Encoder] = []


def held_encoder(tokenizer_json: str, words: bool) -> Encoder:
    """The encoder of this worker's last task, with the words it knows, if it is for the same tokenizer."""
    if not _HELD or (_HELD[0].source, _HELD[0].words) != (tokenizer_json, words):
        _HELD[:] = [Encoder(tokenizer_json, words)]
    return _HELD[0]


class Writer:
    """One file, written from front to back."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, index_docs: int = INDEX_DOCS):
        self.out, self.kind = out, np.dtype(f"<u{width}")
        self.most, self.index_docs = max(1, frame_bytes // width), index_docs
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.table: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []  # ids of the open frame
        self.open = 0
        self.docs, self.tokens, self.token_frames = 0, 0, 0
        self.index: list[bytes] = []  # finished index frames, compressed
        self.index_table: list[tuple[int, int, int]] = []
        self.ids: list[np.ndarray] = []  # (doc_id, null, count) columns of the open index frame
        self.indexed = 0

    def _pressed(self, data: bytes) -> tuple[bytes, tuple[int, int, int]]:
        small = self.press.compress(data)
        return small, (len(small), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        """More documents, with all their ids."""
        at = 0
        while at < len(tokens):
            part = tokens[at : at + self.most - self.open]
            self.held.append(part.astype(self.kind))
            self.open += len(part)
            at += len(part)
            if self.open == self.most:
                self._end_frame()
        self.docs, self.tokens = self.docs + len(doc_ids), self.tokens + len(tokens)
        at = 0
        while at < len(doc_ids):
            stop = at + self.index_docs - self.indexed
            self.ids.append((doc_ids[at:stop], null[at:stop], counts[at:stop]))
            self.indexed += len(doc_ids[at:stop])
            at = stop
            if self.indexed == self.index_docs:
                self._end_index()

    def _end_frame(self) -> None:
        if self.open:
            small, entry = self._pressed(np.concatenate(self.held).tobytes())
            self.out.write(small)
            self.table.append(entry)
            self.held, self.open, self.token_frames = [], 0, self.token_frames + 1

    def _end_index(self) -> None:
        if self.indexed:
            columns = [np.concatenate(x).astype(kind) for x, kind in zip(zip(*self.ids, strict=True), ("<i8", "u1", "<i8"), strict=True)]
            small, entry = self._pressed(b"".join(x.tobytes() for x in columns))
            self.index.append(small)
            self.index_table.append(entry)
            self.ids, self.indexed = [], 0

    def end(self) -> None:
        self._end_frame()
        self._end_index()
        self.out.write(b"".join(self.index))
        head = HEAD.pack(1, self.kind.itemsize, self.token_frames, len(self.index), self.docs, self.tokens)
        self.out.write(SKIP.pack(SKIP_MAGIC, len(head)) + head)
        table = [*self.table, *self.index_table, (SKIP.size + len(head), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = b"".join(ENTRY.pack(*x) for x in table) + FOOTER.pack(len(table), 0x80, FOOTER_MAGIC)
        self.out.write(SKIP.pack(TABLE_MAGIC, len(body)) + body)


class BrokenFile(RuntimeError):
    """A file isn't of this format, or a frame doesn't agree with its checksum."""


class Reader:
    """One file, of which only what is asked for is read and decompressed."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        self.frames_read = 0
        end = source.size()
        count, flags, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size)) if end >= FOOTER.size else (0, 0, 0)
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise BrokenFile("no seek table at the end")
        size = count * ENTRY.size + FOOTER.size
        begin = end - size - SKIP.size
        if begin < 0 or SKIP.unpack(self._at(begin, SKIP.size)) != (TABLE_MAGIC, size):
            raise BrokenFile("the seek table's frame is damaged")
        self.table = np.frombuffer(self._at(begin + SKIP.size, count * ENTRY.size), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        if not count or self.starts[-1] != begin:
            raise BrokenFile("the frames don't fill the file")
        magic, size = SKIP.unpack(self._at(int(self.starts[-2]), SKIP.size))
        if (magic, size) != (SKIP_MAGIC, HEAD.size):
            raise BrokenFile("the counts are damaged")
        version, self.width, self.token_frames, self.index_frames, self.docs, self.tokens = HEAD.unpack(self._at(int(self.starts[-2]) + SKIP.size, HEAD.size))
        if version != 1 or self.token_frames + self.index_frames + 1 != count:
            raise BrokenFile("the counts don't agree with the seek table")
        self.kind = np.dtype(f"<u{self.width}")

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, number: int) -> bytes:
        small, size, check = self.table[number].tolist()
        try:
            data = self.unpack.decompress(self._at(int(self.starts[number]), small), max_output_size=size)
        except zstandard.ZstdError as error:
            raise BrokenFile(f"frame {number} is damaged") from error
        self.frames_read += 1
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise BrokenFile(f"frame {number} doesn't agree with its checksum")
        return data

    def index(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """doc_id, whether it is null, and number of ids, an index frame at a time."""
        for k in range(self.token_frames, self.token_frames + self.index_frames):
            data = self.frame(k)
            n = len(data) // 17
            yield np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, 8 * n).astype(bool), np.frombuffer(data, "<i8", n, 9 * n)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from the file's id number ``start`` on; decompresses the frames that hold them."""
        if not count:
            return np.zeros(0, self.kind)
        upto = np.concatenate([[0], np.cumsum(self.table[: self.token_frames, 1] // self.width)])
        first = int(np.searchsorted(upto, start, side="right")) - 1
        last = int(np.searchsorted(upto, start + count, side="left")) - 1
        held = np.concatenate([np.frombuffer(self.frame(k), self.kind) for k in range(first, last + 1)])
        return held[start - upto[first] :][:count]


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, whether null, ids and counts (with the end id) of bounded parts of the rows."""
    for whole in batches:
        for batch in W.slices(whole, limit=ENCODE_BYTES):
            tokens, counts = encoder(batch.column("text"))
            ends = np.cumsum(counts)
            doc_ids = batch.column("doc_id")
            null = np.asarray(doc_ids.is_null())
            yield np.asarray(pc.fill_null(doc_ids, 0)).astype(np.int64), null, np.insert(tokens, ends, end_id), counts + 1


def write_tokens(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int, words: bool = False, width: int | None = None, frame_bytes: int = FRAME_BYTES, index_docs: int = INDEX_DOCS) -> DataFrame:
    """Write the ids of all documents (doc_id, text) to files in ``folder``; the
    table of files (file, path, start, docs, tokens), whose ``start`` counts the
    ids of all files before, is written to ``folder``/files and returned.

    One row of that table stands for FILE_BYTES of text, and only these rows pass
    the driver. Ids take 2 bytes where the vocabulary allows it, else 4."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    if width is None:
        width = 2 if max(end_id, Tokenizer.from_str(tokenizer_json).get_vocab_size() - 1) < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n")).first()["n"] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("_n").asc()]
    ordered = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder, number = held_encoder(shared.value, words), TaskContext.get().partitionId()
        system, path = filesystem(folder)
        name = f"tokens-{number:06d}-{uuid.uuid4().hex}.zst"
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            writer = Writer(out, width, frame_bytes, index_docs)
            for part in _encoded(_with(first, batches), encoder, end_id):
                writer.add(*part)
            writer.end()
        yield pa.RecordBatch.from_pylist([{"file": number, "path": name, "docs": writer.docs, "tokens": writer.tokens}], pa.schema([("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    ordered.select("doc_id", "text").mapInArrow(write, FILES).write.parquet(f"{folder}/written")
    made, start = [], 0
    for r in spark.read.schema(FILES).parquet(f"{folder}/written").orderBy("file").collect():
        made.append((r["file"], r["path"], start, r["docs"], r["tokens"]))
        start += r["tokens"]
    spark.createDataFrame(made, "file int, path string, start long, docs long, tokens long").coalesce(1).write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


def _with(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


ROWS = "doc_id long, start long, n_tokens long, ids binary"


def _rows(held: list[tuple]) -> pa.RecordBatch:
    doc_id, start, count, ids = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned
    little-endian 32-bit integers) of every document in the files of ``folder``.
    A task reads a file, a frame at a time."""
    files = spark.read.parquet(f"{folder}/files")
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{path}/{r['path']}") as source:
                    yield from _documents(Reader(source), r["start"])

    return files.select("path", "start").repartition(n).mapInArrow(read, ROWS)


def _documents(reader: Reader, base: int) -> Iterator[pa.RecordBatch]:
    frames = (np.frombuffer(reader.frame(k), reader.kind) for k in range(reader.token_frames))
    ready, at, held, size = np.zeros(0, reader.kind), base, [], 0
    for doc_ids, null, counts in reader.index():
        for doc_id, missing, count in zip(doc_ids.tolist(), null.tolist(), counts.tolist(), strict=True):
            parts = [ready[:count]]
            got, ready = len(parts[0]), ready[count:]
            while got < count:
                more = next(frames)
                parts.append(more[: count - got])
                got, ready = got + len(parts[-1]), more[count - got :]
            ids = (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4").tobytes()
            held.append((None if missing else doc_id, at, count, ids))
            at, size = at + count, size + len(ids) + 32
            if size >= W.SLICE_BYTES:
                yield _rows(held)
                held, size = [], 0
    if held:
        yield _rows(held)


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The rows of ``read_tokens`` for a short list of ids (one for each of an id's
    documents). Of each file its index is read, of the token frames only those
    that hold a wanted document."""
    wanted = sorted(set(doc_ids))
    files = spark.read.parquet(f"{folder}/files")
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{path}/{r['path']}") as source:
                    yield from wanted_documents(Reader(source), r["start"], wanted)

    return files.select("path", "start").repartition(n).mapInArrow(read, ROWS)


def wanted_documents(reader: Reader, base: int, wanted: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of the wanted documents of one file; a frame that none of them is in stays compressed."""
    before, ids = 0, np.array(wanted, dtype=np.int64)
    for doc_ids, null, counts in reader.index():
        upto = before + np.concatenate([[0], np.cumsum(counts)])
        for k in np.flatnonzero(np.isin(doc_ids, ids) & ~null).tolist():
            own = reader.ids(int(upto[k]), int(counts[k])).astype("<u4").tobytes()
            yield _rows([(int(doc_ids[k]), base + int(upto[k]), int(counts[k]), own)])
        before = int(upto[-1])


#: Id that ends a document in the query.
END_ID = 2


def tokenizer_json(name: str) -> str:
    """The JSON of a public tokenizer, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = X.scratch(spark, "token-files")
    write_tokens(docs, folder, tokenizer_json("word_bpe_49k.json"), END_ID, words=True)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
