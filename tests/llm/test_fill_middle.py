"""Operator 13 against a plain restatement that walks over the units."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from weftline.llm import fill_middle as fm


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or c % 100 >= 90:
        return n, "plain", None, None, None, text
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, lo), (lo, hi), (hi, n)))
    if d % 100 < 20:
        return n, "spm", pre, mid, suf, "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", pre, mid, suf, "<P>" + pre + "<S>" + suf + "<M>" + mid


@pytest.mark.parametrize("piece", [1 << 20, 5, 1])
def test_units_and_cuts(spark, docs, texts, monkeypatch, piece):
    monkeypatch.setattr(fm, "PIECE", piece)
    for i, (k, t) in enumerate(texts):
        n, form, pre, mid, suf, out = plain_fim(k, t)
        got = fm.transformed(k, t or "")
        assert got[:2] == (n, form) and got[5] == out, i
        if form != "plain":
            assert got[2:5] == (pre, mid, suf)
        assert fm.restored(out, form) == (t or "")


def test_rows(spark, docs, texts, no_docs):
    got = sorted(tuple(map(str, (r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"], r["restored"]))) for r in fm.fill_in_middle(docs).collect())
    want = sorted(tuple(map(str, (k, *plain_fim(k, t), t or ""))) for k, t in texts)
    assert got == want
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(no_docs).count() == 0


def test_marks_and_their_parts(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(["<", "P", "S", "M", ">", "a", "é", "\U0001f600", "\n"]) for _ in range(rng.randint(0, 12)))) for i in range(3000)]
    for k, t in texts:
        n, form, _, _, _, out = plain_fim(k, t)
        got = fm.transformed(k, t)
        assert (got[0], got[1], got[5]) == (n, form, out)
        assert fm.restored(out, form) == t


def test_a_very_long_text(spark):
    text = "word, " * 400_000 + "x" * 2_500_000 + "\U0001f600 " * 1000
    rows = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"]) for r in fm.fill_in_middle(rows).collect()}
    assert got == {i: plain_fim(i, text) for i in range(3)}
