"""Operators 1, 2, 6, 7, 9 and 10 and the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from weftline.llm import decontaminate as de
from weftline.llm import language_id as li
from weftline.llm import lm_score as lm
from weftline.llm import packing as pk
from weftline.llm import topk as tk
from weftline.llm import url_filter as uf
from weftline.llm import words as W


# --- top-k ------------------------------------------------------------------------


def plain_top_k(rows, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % 50 == 0}):
        lists = {(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(u, v, strict=True)))), j) for i, u in usable if i == q for j, v in usable if j != q and len(u) == len(v)}
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(sorted(lists)[:k])]
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(tk, "SHARD_ROWS", 16)
    monkeypatch.setattr(tk, "QUERY_ROWS", 3)
    monkeypatch.setattr(tk, "FAN_IN", 4)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(4)]) for i in range(260)]
    rows += [(7, rows[7][1]), (50, rows[50][1]), (50, [9.0, 1.0, 1.0, 1.0]), (300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (None, [1.0] * 4), (304, []), (350, [1.0, 2.0]), (351, [3.0, 4.0]), (400, [3e38] * 4), (401, [1e30] * 4)]
    df = spark.createDataFrame([(i, None if v is None else v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, tile int")
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = tk.top_k(df.filter("vec_id % 50 = 0"), df, 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain_top_k(as_float, 5)
    assert tk.top_k(df.limit(0), df.limit(0), 5).count() == 0


@pytest.mark.parametrize("vectors", [2, 3, 6, 7])
def test_top_k_of_ids_with_several_vectors(spark, vectors):
    """The query's own vectors take no place, and an id's vectors with one score are one candidate."""
    rng = random.Random(vectors)
    rows = [(50, [float(j), 1.0, 9.0]) for j in range(vectors)] + [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(30)]
    rows += [(31, [0.0, float(j), 1.0]) for j in range(vectors)] + [(32, [1.0, 1.0, float(-j)]) for j in range(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = tk.top_k(df.filter("vec_id % 50 = 0"), df, 5).collect()
    want = plain_top_k(rows, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want and len([w for w in want if w[0] == 50]) == 5


def test_ids_beyond_doubles_stay_apart(spark):
    far = 1 << 53
    rows = [(50, [1.0, 0.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (far + 100, [1.0, 1.0]), (far + 101, [1.0, 1.0]), (far + 102, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = tk.top_k(df.filter("vec_id = 50"), df, 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [far + 100, far + 101, far + 102, 7]


# --- decontamination -----------------------------------------------------------------


@pytest.mark.parametrize("index_bytes", [16 << 20, 2000])
def test_leaks(spark, docs, no_docs, index_bytes, monkeypatch):
    monkeypatch.setattr(de, "INDEX_BYTES", index_bytes)
    rng = random.Random(2)
    letters = "abcdefghijklmnop"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.choice([8, 20, 60, 150])))) for i in range(30)]
    rows, want = [], set()
    for d in range(120):
        body = [word() for _ in range(rng.randint(0, 400))]
        if d % 3 == 0:
            i = rng.randrange(30)
            at = rng.randint(0, len(body))
            body[at:at] = items[i][1].upper().split() if d % 2 else re.findall(r"\S+", items[i][1].replace(" ", ", "))
            want.add((d, i))
        if d % 7 == 0:  # half an item is no leak
            own = items[d % 30][1].split()
            body += own[: len(own) // 2]
        rows.append((d, " ".join(body)))
    rows += [(900, None), (901, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tests = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    found = de.find_leaks(texts, tests).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
    clean = de.clean_documents(texts, tests)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert de.find_leaks(no_docs, tests).count() == 0 and de.find_leaks(texts, tests.limit(0)).count() == 0
    assert de.clean_documents(docs, tests).columns == docs.columns


def test_question_and_answer_must_both_occur(spark):
    items = spark.createDataFrame([(1, "what is the colour of the old mill", "it is a very dark red indeed")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, "x what is the colour of the old mill and it is a very dark red indeed y"), (2, "so what is the colour of the old mill then it is very nice")], "doc_id long, text string")
    assert [r["doc_id"] for r in de.find_leaks(docs, items).collect()] == [1]


def test_retrieval_matches_brute_force():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40))), None) for i in range(25)]
    for threshold in (0.3, 0.6, 0.9):
        index = de.Index(rows, threshold)
        full = np.zeros((len(index.terms), len(index.piece_item)))
        term = np.searchsorted(index.all.key // index.blocks, np.arange(len(index.terms) + 1))
        for t in range(len(index.terms)):
            for e in range(term[t], term[t + 1]):
                full[t, index.all.piece[index.all.first[e] : index.all.last[e]]] = index.all.weight[index.all.first[e] : index.all.last[e]]
        assert np.allclose(full.sum(axis=0), 1)
        asked = [sorted(rng.sample(range(len(index.terms)), rng.randint(1, 50))) for _ in range(40)]
        want = {(p, q) for p, ts in enumerate(asked) for q in np.flatnonzero(full[ts].sum(axis=0) >= threshold - 1e-9).tolist()}
        passage = np.concatenate([np.full(len(x), p) for p, x in enumerate(asked)])
        terms = np.concatenate(asked)
        calls = index.calls[terms]
        got = index.retrieve(passage[calls], terms[calls], lambda ps: (passage[np.isin(passage, ps)], terms[np.isin(passage, ps)]))
        assert set(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


# --- URL filters ----------------------------------------------------------------------


@pytest.mark.parametrize(("shard", "room"), [(1 << 20, 64 << 20), (200, 64 << 20), (200, 400)])
def test_cascade_is_exact(spark, shard, room, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(uf, "SHARD_KEYS", shard)
    monkeypatch.setattr(uf, "BROADCAST_BYTES", room)
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 4000, 9).selectExpr("concat('k', id) as key")
    cascade = uf.build_cascade(listed, universe, rate=0.2)
    rows = cascade.rows.collect()
    assert len(rows) == cascade.shards == -(-3000 // shard) and max(len(uf._read(bytes(r["levels"]))) for r in rows) > 2
    assert (len(cascade.parts()) > 1) == (room == 400)
    some = universe.groupBy(F.floor(F.rand(1) * 50)).agg(F.collect_list("key").alias("keys")).select("keys").union(spark.createDataFrame([([],)], "keys array<string>"))
    got = uf.with_listed(some, cascade, "keys", "m").collect()
    assert len(got) > 40
    for r in got:
        assert r["m"] == [int(k[1:]) % 9 == 0 for k in r["keys"]]
    assert uf.build_cascade(listed.limit(0), universe).rows.count() == 0


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate({i: i + 32 for i in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fits = [(len(h + p), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://net", "http://net/", "https://A.Example.NET/en/x?y=://z", "x://example.net/en", "http://notexample.net/en/", "ftp://example.com/de/?q", "a://b.org/fr/#x", "http://org/fr/x", "http://.org/fr/", "http://example.com:80/de/", "http://ex.net#/en/", "http://a.net/\nb", "://net/x"] * 2
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = uf.judge_urls(pages, uf.RULES).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == [(i, *plain_verdict(u)) for i, u in enumerate(urls)]
    assert uf.judge_urls(pages.limit(0), uf.RULES).count() == 0
    assert {r["verdict"] for r in uf.judge_urls(pages, []).collect()} == {"allow"}


# --- language model ----------------------------------------------------------------------


def test_lm_base_and_held_out(spark, docs, no_docs, texts):
    got = lm.score_texts(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [((t or "").encode().lower().split() + [None]) for _, t in texts]
    count = Counter(x for (i, _), w in zip(texts, tokens, strict=True) if not held(i) for x in w)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, _), w in zip(texts, tokens, strict=True))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_texts(no_docs).count() == 0


def plain_ctw(train, depth):
    """bit counts of every (context, bits so far), and the weighted chance of a one."""
    counts = {}
    for data in train:
        line = b"\0" * depth + data + b"\xff"
        for p in range(depth, len(line)):
            for j in range(8):
                node = (1 << j) | (line[p] >> (8 - j))
                bit = (line[p] >> (7 - j)) & 1
                for d in range(depth + 1):
                    counts.setdefault((line[p - d : p], node), [0, 0])[bit] += 1
    own = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)
    weighted = {}
    children = {}
    for ctx, node in counts:
        if ctx:
            children.setdefault((ctx[1:], node), []).append((ctx, node))
    for key in sorted(counts, key=lambda k: -len(k[0])):
        if len(key[0]) == depth:
            weighted[key] = own(counts[key])
        else:
            weighted[key] = np.logaddexp(own(counts[key]), sum(weighted[c] for c in children.get(key, []))) - math.log(2)

    def one(line, p, node):
        sure, left = 0.0, 1.0
        for d in range(depth + 1):
            n = counts.get((line[p - d : p], node), [0, 0])
            stop = 1.0 if d == depth else math.exp(own(n) - math.log(2) - weighted.get((line[p - d : p], node), 0.0)) if sum(n) else 0.5
            sure += left * stop * (n[1] + 0.5) / (sum(n) + 1)
            left *= 1 - stop
        return sure

    def score(data):
        line, total = b"\0" * depth + data + b"\xff", 0.0
        for p in range(depth, len(line)):
            for j in range(8):
                p1 = one(line, p, (1 << j) | (line[p] >> (8 - j)))
                total += math.log10(p1 if (line[p] >> (7 - j)) & 1 else 1 - p1)
        return total

    return score


@pytest.mark.parametrize("depth", [2, 3, 5, 7])
def test_lm_matches_plain_context_trees(spark, depth):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab cä") for _ in range(rng.randint(0, 60)))) for i in range(25)]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth).collect()}
    score = plain_ctw([t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], depth)
    for i, t in rows:
        assert abs(got[i] - score(t.encode())) < 1e-3 + 1e-5 * abs(got[i]), i


# --- language ID --------------------------------------------------------------------------


def greedy(sample, text):
    """Phrases of the longest-match parse (each at least one byte), afresh every stretch."""
    n = 0
    for at in range(0, len(text), li.STRETCH):
        part, i = text[at : at + li.STRETCH], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
    return n


def test_cross_parsing_matches_plain():
    rng = random.Random(8)
    samples = {"a": bytes(rng.choice(b"abcd ") for _ in range(500)), "b": bytes(rng.choice(b"abxy ") for _ in range(400))}
    texts = [bytes(rng.choice(b"abcdxy z") for _ in range(rng.choice([0, 1, 5, 300, 1500, 3000]))) for _ in range(20)]
    got = li.Model(samples).phrases(W.Block(pa.array(texts, pa.binary())))
    for k, t in enumerate(texts):
        assert got[k].tolist() == [greedy(samples["a"], t), greedy(samples["b"], t)]


SCRIPTS = {
    "en": "The Quick brown fox, 1234567890 times: jumps over the lazy dog & a WIZARD's job VEXES him!",
    "ru": "Съешь же ещё этих мягких французских булок, да выпей чаю",
    "zh": "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏",
    "ar": "نص حكيم له سر قاطع وذو شأن عظيم مكتوب على ثوب أخضر",
    "hi": "ऋषियों को सताने वाले दुष्ट राक्षसों के राजा रावण का सर्वनाश",
}


def test_every_byte_value_and_script_is_learned():
    samples = {k: (t + "\n").encode() * 2 for k, t in SCRIPTS.items()}
    samples["all"] = bytes(range(256))
    assert len({b for t in SCRIPTS.values() for b in t.encode()}) > 63
    texts = [t.encode()[::step] for t in SCRIPTS.values() for step in (1, 2)] + [bytes(range(256))]
    model = li.Model(samples)
    for t, got in zip(texts, model.phrases(W.Block(pa.array(texts, pa.binary()))).tolist(), strict=True):
        assert got == [greedy(samples[k], t) for k in model.names]


def test_texts_in_a_script_that_no_sample_has_are_no_gibberish(spark, tmp_path):
    rng = random.Random(12)
    learned = [(i, " ".join(rng.choice(["the", "house", "of", "with"]) for _ in range(60)), "en") for i in range(40)]
    odd = [(100, SCRIPTS["zh"] * 4, None), (101, "".join(rng.choice("thousewif") for _ in range(400)), None)]
    df = spark.createDataFrame(learned + odd, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, df, str(tmp_path)).collect()}
    assert kept == {100, *range(40)}


def test_language_accuracy_and_odd_texts(spark, docs, no_docs):
    rng = random.Random(9)
    english, german = ["the", "house", "of", "with", "thing", "and"], ["das", "haus", "und", "mit", "dem", "ding"]
    rows = [(i, " ".join(rng.choice(english if i % 2 else german) for _ in range(40)), "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "123 !!", "de"), (102, "", None), (103, "the house", None), (None, "das haus", "de")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    samples = li.gather_samples(df.filter("doc_id < 40"))
    got = {r["doc_id"]: r for r in li.identify(df, samples).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert {r["lang_pred"] for r in li.identify(df, {}).collect()} == {"und"}
    assert li.identify(no_docs, samples).count() == 0


def test_a_small_sample_is_no_handicap(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 7)))
    shared = [word() for _ in range(60)]
    big, small = ([*shared, *(word() for _ in range(40))] for _ in range(2))
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    samples = {"big": text(big, 6000).encode(), "small": text(small, 200).encode(), "tiny": b"abc"}
    rows = [(i, text(small if i % 2 else big, 150)) for i in range(60)]
    got = li.identify(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect()
    assert all(r["lang_pred"] == ("small" if r["doc_id"] % 2 else "big") for r in got)


def test_samples_fill_up_from_short_texts_and_any_number_of_languages(spark):
    rows = [(f"short text number {i}", "a") for i in range(1500)] + [("x" * 9000, "b")] + [("only one", "c")]
    got = li.gather_samples(spark.createDataFrame(rows, "text string, lang string"), sample_bytes=20_000)
    assert 18_000 <= len(got["a"]) <= 20_000 and got["b"] == b"x" * 2000 + b"\n" and got["c"] == b"only one\n"
    long = "".join(f"{i:06d}" for i in range(3000))
    own = li.gather_samples(spark.createDataFrame([(long, "d")], "text string, lang string"), sample_bytes=20_000)["d"].decode()
    assert len(own) == 2001 and own[:-1] in long and not long.startswith(own[:-1])
    many = spark.createDataFrame([(f"a text in language {i}", f"l{i}") for i in range(230)], "text string, lang string")
    assert len(li.gather_samples(many)) == 230


# --- packing --------------------------------------------------------------------------------


def least_padding(lengths, counts, buckets):
    n = len(lengths)
    best = [[10**18] * (n + 1) for _ in range(buckets + 1)]
    best[0][0] = 0
    for k in range(1, buckets + 1):
        for j in range(1, n + 1):
            for i in range(j):
                best[k][j] = min(best[k][j], best[k - 1][i] + sum(counts[t] * (lengths[j - 1] - lengths[t]) for t in range(i, j)))
    return min(best[k][n] for k in range(1, buckets + 1))


@pytest.mark.parametrize("seed", range(30))
def test_boundaries_are_best(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(100), rng.randint(1, 12)))
    counts, buckets = [rng.randint(1, 9) for _ in lengths], rng.randint(1, 6)
    bounds = pk.best_boundaries(lengths, counts, buckets)
    padding = sum(n * (bounds[pk.bucket_of(x, bounds)] - x) for x, n in zip(lengths, counts, strict=True))
    assert padding == least_padding(lengths, counts, buckets) and len(bounds) <= buckets


def test_packing(docs, no_docs, texts):
    got = pk.pack(docs, buckets=4, token_budget=500).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in texts)
    sizes = Counter(len((t or "").encode().split()) for _, t in texts)
    assert Counter(r["n_tokens"] for r in got) == sizes
    assert sum(r["padding"] for r in got) == least_padding(sorted(sizes), [sizes[x] for x in sorted(sizes)], 4)
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, number), own in batches.items():
        room = max(1, 500 // max(own[0]["bucket_tokens"], 1))
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and len(own) <= room
        assert len(own) == room or (bucket, number + 1) not in batches
    assert pk.pack(no_docs).count() == 0


def test_one_very_long_document_leaves_the_other_boundaries_exact(spark):
    rng = random.Random(11)
    sizes = Counter(rng.randint(1, 60) for _ in range(300)) + Counter([200_000])
    df = spark.createDataFrame(list(enumerate(sizes.elements())), "doc_id long, n long")
    from pyspark.sql import functions as F

    got = pk.pack(df, F.col("n"), buckets=5).collect()
    assert Counter(r["n_tokens"] for r in got) == sizes and {r["bucket_tokens"] for r in got} <= set(sizes)
    assert sum(r["padding"] for r in got) == least_padding(sorted(sizes), [sizes[x] for x in sorted(sizes)], 5)


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline(spark, docs, no_docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, kept, str(tmp_path))
        if name != "packing":
            assert rows.columns == corpus_pipeline.COLUMNS
        rows.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        ids.append({r["doc_id"] for r in kept.collect()})
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
    assert not ids[0] & {70, 71, 72, 77, 78} and ids[0] >= set(range(40))
    assert ids[2] & {3, *range(60, 66)} == {3} and ids[2] & {73, 74} == {73}
    assert 73 not in ids[3] and ids[3] == ids[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept.count()


def test_one_row_of_each_group_of_near_copies_stays(spark, tmp_path):
    rng = random.Random(13)
    a, b, c = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(120)) for _ in range(3))
    near = lambda t, k: " ".join(t.split()[:-k] + ["x"] * k)
    rows = [(3, a), (5, near(a, 1)), (5, b), (7, c), (7, near(c, 1)), (8, c), (None, c), (None, near(b, 2)), (None, "quite alone here"), (None, "quite alone here"), (9, ""), (9, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, df, str(tmp_path)).collect()]
    sevens = [t for i, t in got if i == 7]
    assert len(sevens) == 1 and sevens[0] in (c, near(c, 1))
    assert sorted((str(x) for x in got if x[0] != 7)) == sorted(str(x) for x in [(3, a), (5, b), (None, "quite alone here"), (9, ""), (9, ""), (None, None)])
