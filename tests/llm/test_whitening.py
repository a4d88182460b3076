"""Operator 12 against numpy and Python's whole numbers."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from weftline.llm import whitening as wh

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain_x(v):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [max(-(1 << 62), min(1 << 62, math.floor(64 * c) if abs(64 * c) < 1e300 else int(math.copysign(1 << 62, c)))) + 1_000_000 for c in v]


def check(rows, got, components=16):
    """rows: (vec_id, vector of doubles)."""
    usable = [(i, tuple(x)) for i, v in rows if (x := plain_x(v))]
    by_dim = {d: sorted({x for _, x in usable if len(x) == d}) for d in {len(x) for _, x in usable}}
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c) for i, x in usable for c in range(1, min(components, len(x)) + 1))
    by_place = {}
    for r in got:
        by_place.setdefault((r["vec_id"], r["n"]), []).append(r)
    for d, fit in by_dim.items():
        n = len(fit)
        sums = [sum(x[j] for x in fit) for j in range(d)]
        centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in fit])
        covariance = centred.T @ centred / n
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        live = values[:components] > 1e-12 * values[0] if values[0] > 0 else np.zeros(min(d, components), bool)
        for i, x in usable:
            if len(x) != d:
                continue
            same = [r for r in by_place[i, n] if sum((n * x[j] - sums[j]) ** 2 for j in range(d)) == r["deviation"]] if n else []
            want = sum((n * x[j] - sums[j]) ** 2 for j in range(d))
            if want < 1 << 63:
                assert same, i
            for r in same:
                c = r["component"] - 1
                assert (r["whitened"] is not None) == bool(live[c])
                if values[0] > 0:
                    assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-6, abs=1e-12)
                if live[c]:
                    assert r["identity_error"] <= 1e-4
        # whitened vectors of the fit list have covariance one and lie along the components
        first = {}
        for i, x in usable:
            if len(x) == d and len({y for k, y in usable if k == i}) == 1 and [k for k, _ in usable].count(i) == 1:
                first.setdefault(x, i)
        if len(first) == n and live.any():
            y = np.array([[next(r["whitened"] for r in by_place[first[x], n] if r["component"] == c + 1) for c in range(min(d, components)) if live[c]] for x in fit], dtype=float)
            assert np.abs(y.T @ y / n - np.eye(y.shape[1])).max() < 1e-6
            for c in range(y.shape[1]):
                gap = np.abs(np.delete(values, c) - values[c]).min(initial=np.inf) / values[0]
                if gap > 1e-6:
                    own = centred @ vectors[:, c] / math.sqrt(values[c])
                    assert min(np.abs(own - y[:, c]).max(), np.abs(own + y[:, c]).max()) < 1e-6


def as_float(rows):
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]


def test_whitening(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + j) + (0.5 if j == 2 else 0) for j in range(5)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a vector that a third of all rows hold counts once
    rows += [(1300, None), (1301, [1.0, None, 0.0, 0.0, 0.0]), (1302, [float("nan")] * 5), (1303, [float("-inf")] * 5), (None, [0.25] * 5), (1304, [])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, n int, x string, dim int").repartition(3)
    check(as_float(rows), wh.whiten(df, block_rows=64).collect())
    check(as_float(rows), wh.whiten(df, components=2).collect(), components=2)
    assert wh.whiten(df.limit(0)).count() == 0


def test_lengths_constants_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, [rng.random(), rng.random(), 3.0]) for i in range(50)]  # a constant dimension
    rows += [(100 + i, [rng.random(), rng.random()]) for i in range(40)] + [(200, [1.0]), (201, [1.0])] + [(7, [9.0, 9.0, 3.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = wh.whiten(df).collect()
    check(rows, got)
    assert {(r["whitened"], r["explained"], r["identity_error"]) for r in got if r["vec_id"] == 200} == {(None, None, None)}
    assert {r["n"] for r in got if r["vec_id"] == 201} == {1}


def test_great_values(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 5, 12, 30]) for _ in range(3)]) for i in range(30)] + [(90, [1.7e308, -1.7e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = wh.whiten(df).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, c) for i, _ in rows for c in (1, 2, 3))
    fit = [plain_x(v) for _, v in rows]
    sums = [sum(x[j] for x in fit) for j in range(3)]
    for r in got:
        want = sum((31 * (x := plain_x(dict(rows)[r["vec_id"]]))[j] - sums[j]) ** 2 for j in range(3))
        assert r["deviation"] == (want if want < 10**38 else None)


def test_moments_of_blocks_are_exact():
    rng = np.random.default_rng(1)
    for high in (2, 200, 1 << 20, 1 << 40, 1 << 62):
        x = rng.integers(-high, high, size=(130, 4))
        sums, products = wh.block_moments(x)
        whole = x.astype(object)
        assert sums.tolist() == whole.sum(axis=0).tolist()
        assert products.tolist() == whole.T.dot(whole).tolist()


@pytest.mark.parametrize("folder", [SMALL, LARGER])
def test_query_on_whole_tables(spark, folder):
    rows = [(r["vec_id"], None if r["embedding"] is None else [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(rows, wh.op12_whitening(spark, folder).collect())


def test_counts_and_deviations_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{LARGER}/embeddings.parquet'")
    want = con.execute("""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        f AS (SELECT DISTINCT x FROM v), e AS (SELECT unnest(x) AS c, generate_subscripts(x, 1) AS j FROM f),
        s AS (SELECT list(total ORDER BY j) AS s FROM (SELECT j, CAST(sum(c) AS BIGINT) AS total FROM e GROUP BY j)), n AS (SELECT count(*) AS n FROM f)
        SELECT vec_id, n, CAST(list_sum(list_transform(list_zip(x, s), lambda p: (n * p[1] - p[2]) * (n * p[1] - p[2]))) AS BIGINT) FROM v, s, n""").fetchall()
    got = wh.op12_whitening(spark, LARGER).filter("component = 1").select("vec_id", "n", "deviation").collect()
    assert sorted(map(tuple, got)) == sorted(want)
