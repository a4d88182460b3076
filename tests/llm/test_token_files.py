"""Operator 11: ids are those of the whole texts, files can be read back in part, damage shows."""

from __future__ import annotations

import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from weftline.llm import token_files as tf
from weftline.llm import words as W

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def json_text():
    return tf.tokenizer_json("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole(json_text):
    """The ids of a whole text, by the library alone."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json_text)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def ids_by_text(encoder, texts):
    flat, counts = encoder(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_words_give_the_ids_of_the_whole_text(json_text, whole, texts, monkeypatch):
    monkeypatch.setattr(tf, "KNOWN_PIECES", 50)
    monkeypatch.setattr(tf, "KNOWN_IDS", 400)
    rng = random.Random(5)
    parts = [chr(c) for c in range(256)] + ["́", "̣", "é", " ́", "\u0085", " ", " ", "　", "​", "﻿", "Σ", "İ", "가", "'s", "'LL", "don't", "12", "<|endoftext|>", "<|startoftext|>", "\U0001f600", "  ", "\r\n", "Ⅷ", "中文", "ſ", "ª", "µ", "ß", "Ÿ", "ÿ", "Å", "É.", "word,", "End!?", "it's.", "a&&&", "b$%#", "c).", "d)e", "***", "o'clock;"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    own = [t for _, t in texts] + odd + [f"a{c}b" for c in parts]
    encoder = tf.Encoder(json_text, words=True)
    for _ in range(2):  # the second time from what is remembered
        assert ids_by_text(encoder, own) == [whole(t) for t in own]
    assert ids_by_text(tf.Encoder(json_text, words=False), own[:50]) == [whole(t) for t in own[:50]]


def expected(rows, whole):
    """doc_id, start, n_tokens, crc of all but the order among rows of one id."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out, start = [], 0
    for i, t in order:
        ids = [*whole(t), 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("frame", [64, 1 << 18])
def test_files_hold_all_documents_in_order(spark, docs, texts, json_text, whole, tmp_path, frame):
    folder = f"{tmp_path}/out"
    files = tf.write_tokens(docs, folder, json_text, 2, words=True, frame_bytes=frame, index_docs=3).collect()
    got = sorted(tf.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, *_ in expected(texts, whole)]
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"] * 4) == (at, len(r["ids"]))
        at += r["n_tokens"]
    assert sum(f["tokens"] for f in files) == at and sum(f["docs"] for f in files) == len(texts)
    assert sorted((str(r["doc_id"]), r["n_tokens"], zlib.crc32(r["ids"])) for r in got) == sorted((str(i), n, c) for i, _, n, c in expected(texts, whole))


def test_a_lookup_decompresses_only_the_frames_it_needs(spark, docs, texts, json_text, tmp_path):
    folder = f"{tmp_path}/out"
    files = tf.write_tokens(docs, folder, json_text, 2, words=True, frame_bytes=64, index_docs=3).collect()
    every = tf.read_tokens(spark, folder).collect()
    got = tf.lookup(spark, folder, [3, 70, 999, 3]).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in every if r["doc_id"] in (3, 70))
    path = next(f"{folder}/{f['path']}" for f in files if f["docs"] > 5)
    reader = tf.Reader(pa.OSFile(path))
    assert reader.token_frames > 5
    first = next(reader.index())
    before = reader.frames_read
    own = reader.ids(0, 3)
    assert len(own) == 3 and reader.frames_read == before + 1 and len(first[0]) <= 3


def test_files_follow_the_formats(spark, docs, json_text, tmp_path):
    """The frames are ordinary zstandard, and a plain decompressor reads them in a row."""
    folder = f"{tmp_path}/out"
    files = tf.write_tokens(docs, folder, json_text, 2, words=True).collect()
    for f in files:
        data = open(f"{folder}/{f['path']}", "rb").read()
        reader = tf.Reader(pa.OSFile(f"{folder}/{f['path']}"))
        assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1 and struct.unpack("<IBI", data[-9:])[0] == len(reader.table)
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
        assert stream.read(f["tokens"] * reader.width) == b"".join(reader.frame(k) for k in range(reader.token_frames))


def test_damage_shows(spark, docs, json_text, tmp_path):
    folder = f"{tmp_path}/out"
    f = tf.write_tokens(docs, folder, json_text, 2, words=True).first()
    data = bytearray(open(f"{folder}/{f['path']}", "rb").read())
    reader = tf.Reader(pa.BufferReader(bytes(data)))
    for place in (len(data) - 1, len(data) - 5, int(reader.starts[-2]) + 1, int(reader.starts[1]) - 1, 12):
        broken = bytearray(data)
        broken[place] ^= 0x40
        with pytest.raises(tf.BrokenFile):
            bad = tf.Reader(pa.BufferReader(bytes(broken)))
            for k in range(bad.token_frames + bad.index_frames):
                bad.frame(k)
    with pytest.raises(tf.BrokenFile):
        tf.Reader(pa.BufferReader(b""))


def test_empty_wide_and_hot(spark, no_docs, json_text, tmp_path, whole):
    assert tf.write_tokens(no_docs, f"{tmp_path}/none", json_text, 2).count() == 0
    assert tf.read_tokens(spark, f"{tmp_path}/none").count() == 0
    hot = spark.createDataFrame([(7, "the same row")] * 300 + [(None, None)] * 5, "doc_id long, text string").repartition(3)
    files = tf.write_tokens(hot, f"{tmp_path}/hot", json_text, 70_000).collect()
    assert max(f["docs"] for f in files) < 200  # rows that are the same go to several files
    got = sorted(tf.read_tokens(spark, f"{tmp_path}/hot").collect(), key=lambda r: r["start"])
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [[*whole("the same row"), 70_000]] * 300 + [[70_000]] * 5


def test_a_very_long_text(spark, json_text, whole, tmp_path):
    text = "Some words, and more; " * 150_000 + "x" * 30_000
    rows = spark.createDataFrame([(1, "first"), (2, text), (3, None)], "doc_id long, text string")
    tf.write_tokens(rows, f"{tmp_path}/out", json_text, 2, words=True)
    got = sorted(tf.read_tokens(spark, f"{tmp_path}/out").collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got] == expected([(1, "first"), (2, text), (3, None)], whole)
    assert len(got[1]["ids"]) > W.SLICE_BYTES


def test_query_on_whole_tables(spark, whole):
    got = sorted(tf.op11_token_files(spark, LARGER).collect(), key=lambda r: r["start"])
    rows = [tuple(r) for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()]
    assert [tuple(r) for r in got] == expected(rows, whole)
