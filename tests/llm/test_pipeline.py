"""The whole pipeline against a plain restatement of its five stages."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
from tests.llm.conftest import passage
from tests.llm.test_dedup import WHITE, components, encoded
from tests.llm.test_models import greedy, least_padding
from weftline.llm import exchange
from weftline.llm import language_id as li

GERMAN = ["und", "der", "straße", "über", "haus", "nicht", "schön", "wald", "wasser", "zeit"]


def made():
    """(doc_id, text, lang): two languages, copies, frequent lines, test items, gibberish, ids that repeat or are missing."""
    rng = random.Random(31)
    items = [(i, passage(rng, 40)) for i in range(4)]
    line = "This line stands in very many documents"
    out = []
    for i in range(60):
        german = i % 3 == 0
        body = [" ".join(rng.choice(GERMAN) + rng.choice(["", "en", "s"]) for _ in range(60)) if german else passage(rng, 60) for _ in range(2)]
        if i % 4 == 1:
            body.insert(1, line.upper() if i % 8 == 1 else line + " ")
        if i % 10 == 7:
            body.append(items[i // 10 % 4][1])
        out.append((i, "\n".join(body), "de" if german else "en"))
    near = out[7][1].split()
    near[3] = "changed"
    out += [(100, " ".join(near), "en"), (101, out[5][1], "en"), (None, out[8][1], None), (None, "no id and alone\nin two lines", "en"), out[9], out[9]]
    out += [(200 + i, line, "en") for i in range(4)] + [(300, "".join(rng.choice("qxzjkvwy") for _ in range(600)), None), (301, None, "en"), (302, "", "de"), (303, " 12 34 ", "en"), (304, "short text", "en"), (305, "x " * 30_000 + "the end", "en")]
    return out, items


def plain_language(rows, samples):
    names = sorted(samples)
    cost = {k: math.log(len(samples[k]) + 256) for k in names}
    known = set(b"".join(samples.values()))
    out = []
    for row in rows:
        data = encoded(row[1])
        if not re.search(r"[^\W\d_]", row[1] or ""):
            continue
        phrases = {k: greedy(samples[k], data) for k in names}
        best = min(names, key=lambda k: (phrases[k] * cost[k], k))
        share = sum(b in known for b in data) / len(data)
        if not (len(data) >= 200 and len(data) / phrases[best] < 1.5 and share >= 0.5):
            out.append(row)
    return out


def plain_lines(rows):
    of = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    own = [{of(x) for x in (t or "").split("\n")} - {""} for _, t, _ in rows]
    count = Counter(k for keys in own for k in keys)
    owner = {k: min((i for (i, _, _), keys in zip(rows, own, strict=True) if k in keys and i is not None), default=None) for k in count}
    out = []
    for i, t, lang in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[of(x)] < 10 or owner[of(x)] == i]
        if len(kept) == len(lines) or "\n".join(kept).strip(WHITE):
            out.append((i, "\n".join(kept), lang))
    return out


def plain_near(rows):
    texts = list(enumerate(t for _, t, _ in rows))  # rows are judged by themselves
    groups = {}
    for k, (_, n, root) in enumerate(components(texts, 5)):
        groups.setdefault(root if n else -1 - k, []).append(rows[k])
    return [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in groups.values()]


def plain_clean(rows, items):
    word = lambda t: re.findall(r"[a-z0-9\x80-\xff]+", encoded(t).lower().decode("latin-1"))
    grams = lambda w: {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)}
    sides = []
    for _, t in items:
        w = word(t)
        cut = len(w) - max(1, len(w) // 4)
        sides.append((grams(w[:cut]), grams(w[cut:])))
    out = []
    for row in rows:
        own = grams(word(row[1]))
        if not any(all(len(s & own) >= 0.8 * len(s) for s in both) for both in sides):
            out.append(row)
    return out


def shown(rows):
    return sorted(map(str, rows))


def test_pipeline_matches_plain_stages(spark, tmp_path):
    rows, items = made()
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    learned = frame.filter(~li.held_out())
    samples = li.gather_samples(learned)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    for lang, data in samples.items():  # all texts that fit are in the sample, each once
        short = [t for i, t, own in rows if own == lang and t and not held(i) and len(t.encode()) <= 4000]
        assert Counter(x for t in short for x in t.split("\n")) - Counter(data.decode().split("\n")) == Counter()
    want = [plain_language(rows, samples)]
    want.append(plain_lines(want[0]))
    want.append(plain_near(want[1]))
    want.append(plain_clean(want[2], items))
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 30
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), own in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert shown((r["doc_id"], r["text"], r["lang"]) for r in docs.collect()) == shown(own), name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    sizes = Counter(len(encoded(t).split()) for _, t, _ in want[3])
    before = exchange.scratch_folders()
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(exchange.scratch_folders()) == len(before) + 1  # the rows that were just read
    assert Counter(r["n_tokens"] for r in packed) == sizes and shown(r["doc_id"] for r in packed) == shown(i for i, _, _ in want[3])
    assert sum(r["padding"] for r in packed) == least_padding(sorted(sizes), [sizes[x] for x in sorted(sizes)], 16)


def test_stages_of_odd_tables(spark, no_docs, tmp_path):
    """Empty tables, tables without some columns, and columns whose names the stages use themselves."""
    rows, items = made()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = spark.createDataFrame([(i, t, "b", 1, b"k") for i, t, _ in rows[:12]], "doc_id int, text string, block string, row int, keys binary")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name
        got = stage(spark, odd, str(tmp_path))
        assert got.count() in ((0,) if name == "language_id" else (11, 12)), name  # nothing is labelled here
