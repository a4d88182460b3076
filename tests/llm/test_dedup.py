"""Operators 3, 4, 5 and 8 against plain restatements."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import line_dedup as ld
from weftline.llm import minhash_dedup as md
from weftline.llm import suffix_dedup as sd
from weftline.llm import words as W
from weftline.llm.components import connected
from weftline.llm.substring_dedup import remove_repeated_passages

sha = lambda b: hashlib.sha256(b).hexdigest()


def encoded(t):
    return (t or "").encode()


def masks(sequences, length):
    count = Counter(bytes_or_tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        mask = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[bytes_or_tuple(s[i : i + length])] > 1:
                mask[i : i + length] = [True] * length
        out.append(mask)
    return out


def bytes_or_tuple(x):
    return x if isinstance(x, bytes) else tuple(x)


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_substring_dedup(docs, no_docs, texts):
    words = [encoded(t).split() for _, t in texts]
    want = [(i, len(w), sum(m), sha(b" ".join(x for x, y in zip(w, m, strict=True) if not y))) for (i, _), w, m in zip(texts, words, masks(words, 35), strict=True)]
    got = remove_repeated_passages(docs, 35).collect()
    assert key((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == key(want)
    assert all(sha(r["kept_text"].encode()) == r["kept_sha256"] for r in got)
    assert remove_repeated_passages(no_docs, 35).count() == 0


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(docs, no_docs, texts, hot, monkeypatch):
    monkeypatch.setattr(sd, "HOT", hot)
    data = [encoded(t) for _, t in texts]
    want = []
    for (i, _), b, m in zip(texts, data, masks(data, 400), strict=True):
        spans = sum(y and (k == 0 or not m[k - 1]) for k, y in enumerate(m))
        want.append((i, len(b), sum(m), spans, sha(bytes(x for x, y in zip(b, m, strict=True) if not y))))
    got = sd.remove_repeated_strings(docs, 400).collect()
    assert key((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == key(want)
    assert sd.remove_repeated_strings(no_docs, 400).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_two_stage_windows(seed):
    rng = random.Random(seed)
    length = rng.choice([8, 12, 16, 33])
    letters = rng.choice([b"ab", b"a", b"abc", b"abcdefgh"])
    out = []
    for _ in range(rng.randint(1, 6)):
        t = bytes(rng.choice(letters) for _ in range(length + rng.randint(0, 60)))
        if out and rng.random() < 0.6:
            other = rng.choice(out)
            at = rng.randrange(len(other))
            t = t[:10] + other[at : at + length + 9] + t[10:]
        out.append(t)
    out = list(dict.fromkeys(out))
    count = Counter(t[i : i + length] for t in out for i in range(len(t) - length + 1))
    want = [[count[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in out]
    assert [x.tolist() for x in sd.repeated_windows(out, length)] == want


def test_whole_suffix_order():
    rng = random.Random(3)
    text = bytes(rng.choice(b"abba") for _ in range(300)) + b"\xff"
    data = np.frombuffer(text, np.uint8)
    order = sd.two_stage(data, np.append(np.ones(300, bool), False), 400)
    assert order.tolist() == sorted(range(300), key=lambda i: text[i:])


WHITE = " \t\n\x0b\x0c\r"


def line_result(texts, least):
    def of(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    lines = [(t or "").split("\n") for _, t in texts]
    count = Counter(k for own in lines for k in {of(x) for x in own})
    out = []
    for (i, _), own in zip(texts, lines, strict=True):
        kept = [x for x in own if not of(x) or count[of(x)] < least]
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept).encode())))
    return out


@pytest.mark.parametrize("shard", [100_000, 2])
def test_line_dedup(docs, no_docs, texts, shard, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", shard)
    got = ld.drop_frequent_lines(docs, 10).collect()
    assert key((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == key(line_result(texts, 10))
    assert ld.drop_frequent_lines(no_docs, 10).count() == 0


def test_lines_stay_with_their_owner(spark):
    rows = spark.createDataFrame([(i, "same line\nown %d" % i) for i in range(12)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in ld.drop_frequent_lines(rows, 10, keep_owner=True).collect()}
    assert got == {0: 0, **{i: 1 for i in range(1, 12)}}


def test_line_counts_are_reversible(spark, docs):
    some = docs.filter("doc_id < 30")
    rest = docs.filter("doc_id >= 30 or doc_id is null")
    rows = lambda df: sorted(map(str, df.select("key", "n", "owner").collect()))
    before = ld.line_references(some)
    after = ld.changed_references(before, added=rest)
    assert rows(ld.counts_of(after)) == rows(ld.line_counts(docs))
    assert rows(ld.counts_of(ld.changed_references(after, removed=rest))) == rows(ld.line_counts(some))


@pytest.mark.parametrize("shard", [100_000, 1])
@pytest.mark.parametrize("keep_owner", [False, True])
def test_incremental_runs_equal_fresh_ones(spark, docs, keep_owner, shard, tmp_path, monkeypatch):
    """Saved, loaded, inserted to and deleted from, the state judges as one made of the same documents."""
    monkeypatch.setattr(ld, "SHARD_KEYS", shard)
    first, rest = docs.filter("doc_id >= 12 or doc_id is null"), docs.filter("doc_id < 12")
    gone = docs.filter("doc_id between 2 and 20")
    ld.new_state(first, 5).save(str(tmp_path / "a"))
    state = ld.changed_state(ld.LineState.load(spark, str(tmp_path / "a")), added=rest)
    state.save(str(tmp_path / "b"))
    left = docs.filter("not coalesce(doc_id between 2 and 20, false)")
    steps = [(state, docs), (ld.changed_state(ld.LineState.load(spark, str(tmp_path / "b")), removed=gone), left)]
    steps.append((ld.changed_state(steps[1][0], added=gone), docs))
    rows = lambda df: sorted(map(str, df.collect()))
    for kept, own in steps:
        fresh = ld.drop_frequent_lines(own, 5, keep_owner=keep_owner, carry=["lang"])
        assert rows(ld.drop_frequent_lines(own, 5, keep_owner=keep_owner, carry=["lang"], state=kept)) == rows(fresh)


def test_filters_follow_insertions_and_deletions_and_grow(spark):
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(6000)]
    frame = lambda x: spark.createDataFrame([(k, 1) for k in x], "key binary, owner long")
    filters = ld.build_filters(frame(keys[:500]), 3)
    for lo, hi in ((0, 1000), (500, 5000), (4000, 4100)):
        filters = ld.build_filters(frame(keys[lo:hi]), 3, filters)
        rows = {r["shard"]: r for r in filters.collect()}
        shard = ld._sharding(b"".join(keys), 3)
        for s, r in rows.items():
            own = [i for i in range(6000) if shard[i] == s]
            filt = ld.Cuckoo(slots=bytes(r["slots"]), stash=bytes(r["stash"]))
            hit = filt.holds(ld._halves(b"".join(keys[i] for i in own))[1])
            inside = np.array([lo <= i < hi for i in own])
            assert hit[inside].all() and hit[~inside].mean() < 0.02 and filt.fits(int(inside.sum()))
            assert sorted(ld._split(bytes(r["keys"]))) == sorted(keys[i] for i in own if lo <= i < hi)


def shingles(text, size):
    w = encoded(text).lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def components(texts, size, percent=80):
    sets = [shingles(t, size) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(find(k), []).append(texts[k][0])
    low = {r: min((i for i in own if i is not None), default=None) for r, own in groups.items()}
    return [(texts[k][0], len(sets[k]), low[find(k)] if sets[k] else texts[k][0]) for k in range(len(texts))]


@pytest.mark.parametrize("cell", [512, 3])
def test_near_duplicates(docs, no_docs, texts, cell, monkeypatch):
    monkeypatch.setattr(md, "CELL_CLASSES", cell)
    monkeypatch.setattr(md, "BAND_CLASSES", cell)
    got = md.near_duplicates(docs, size=4).collect()
    assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == key(components(texts, 4))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert md.near_duplicates(no_docs, size=4).count() == 0


def test_clusters_of_many_blocks_lose_no_link(spark, monkeypatch):
    """Chains and knots of near copies over many small cells, with ids that repeat or are missing."""
    monkeypatch.setattr(md, "CELL_CLASSES", 4)
    monkeypatch.setattr(md, "BAND_CLASSES", 4)
    rng = random.Random(21)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(30):  # each changes a few words of the one before
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(60)] = f"x{rng.randrange(9999)}"
            rows.append((rng.choice([None, rng.randrange(40), 100 * g + k]), " ".join(base)))
    got = md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == key(components(rows, 4))


def test_shared_boilerplate_makes_no_clusters(spark, monkeypatch):
    """Short pages of one site meet in large bands; none is near another, so nothing is compared exactly, however many there are."""
    monkeypatch.setattr(md, "BAND_CLASSES", 16)
    cells = []
    monkeypatch.setattr(md, "_exact_links", lambda rows, percent, real=md._exact_links: cells.append(rows.count()) or real(rows, percent))
    sizes = []
    monkeypatch.setattr(md, "_rare_rows", lambda sets, percent, real=md._rare_rows: sizes.append(sets.count()) or real(sets, percent))
    for n in (300, 600):
        rows = [(i, f"this page is about item{i}") for i in range(n)]
        got = md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i) for i in range(n)]
    assert cells == [0, 0] and all(sizes)
    # with copies among them the copies are found
    rows += [(1000 + i, f"this page is about item{i} and of nothing else than item{i} {'and on ' * (i % 2)}") for i in range(40)]
    rows += [(2000 + i, t) for i, t in rows[-20:]]
    got = md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == key(components(rows, 4))


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_near_sets_share_a_shingle_of_their_prefixes(percent):
    rng = random.Random(percent)
    for _ in range(3000):
        a = set(rng.sample(range(30), rng.randint(1, 20)))
        b = {x for x in a if rng.random() < 0.9} | set(rng.sample(range(30), rng.randint(0, 3)))
        if b and 100 * len(a & b) >= percent * len(a | b):
            first = [set(sorted(s)[: md.prefix_length(len(s), percent)]) for s in (a, b)]
            assert first[0] & first[1]


def test_likely_pairs_of_bands():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 16, (3, 256)).astype(np.uint8)
    near = base.copy()
    near[:, :40] = rng.integers(0, 16, (3, 40))
    band = np.array([1, 1, 1, 2, 2, 3, 3, 3])
    bins = np.stack([base[0], near[0], base[1], base[1], near[2], base[2], near[2], base[1]])
    i, j = md.alike(band, bins)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(1, 0), (6, 5)]
    assert md.alike(band[:0], bins[:0])[0].tolist() == []


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 1 << 63, 80).astype(np.uint64)])
    one = np.array([9], np.uint64)
    key_ = np.concatenate([np.sort(a), np.sort(b), one])
    made = md.sketches(key_, np.array([0, 400, 800, 801, 801]))
    unset = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (made[:3] != unset).all() and (made[3] == unset).all()
    assert abs((made[0] == made[1]).mean() - 320 / 480) < 0.12


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(1, 50)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(50)}}


def test_words_match_python_splitting(texts):
    import pyarrow as pa

    block = W.Block(pa.array([t for _, t in texts], pa.string()))
    starts, ends, first = block.words()
    for k, (_, t) in enumerate(texts):
        own = [block.data[a:b].tobytes() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
        assert own == encoded(t).split()


def test_texts_pass_other_columns_by(docs):
    assert ld.drop_frequent_lines(docs, 10, carry=["lang", "n_chars"]).columns == ["doc_id", "lang", "n_chars", "n_lines", "n_dropped", "kept_text", "kept_sha256"]
    assert docs.filter(F.col("doc_id").isNull()).count() == 2
