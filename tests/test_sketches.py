"""Sketches of chunks, kept and merged, against exact counts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftline.operators import profile
from weftline.operators import sketches as sk


def rows_of(spark, n=6000):
    rng = random.Random(4)
    rows = [(i, f"c{i // 1000}", f"name {rng.randrange(n)}", rng.choice("abc"), rng.gauss(0, 10), None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, chunk string, name string, kind string, price double, nothing string")


def test_chunks_are_kept_once_and_merged(spark, tmp_path):
    rows, folder = rows_of(spark), str(tmp_path / "s")
    names = ["id", "name", "kind", "price", "nothing"]
    assert sk.keep(spark, folder, rows.filter("id < 2000"), "chunk", names) == 2
    changed = rows.withColumn("kind", F.when(F.col("id") < 2000, F.lit("z")).otherwise(F.col("kind")))
    assert sk.keep(spark, folder, changed, "chunk", names) == 6  # known chunks aren't read again
    got = {r["column"]: r for r in sk.merged(sk.kept(spark, folder)).collect()}
    exact = {r["column"]: r for r in profile.cardinality(rows, names).collect()}
    for c in names:
        assert got[c]["rows"] == 6000 and got[c]["non_null"] == exact[c]["non_null"]
        assert abs(got[c]["distinct"] - exact[c]["distinct"]) <= 0.05 * exact[c]["distinct"]
    assert got["kind"]["distinct"] == 3 and got["nothing"]["ratio"] == 0.0
    q = {r["column"]: r["quantiles"] for r in sk.quantiles(sk.merged(sk.kept(spark, folder)), [0.0, 0.5, 0.95, 1.0]).collect()}
    values = sorted(r["price"] for r in rows.select("price").collect())
    assert set(q) == {"id", "price"} and q["price"][0] == values[0] and q["price"][3] == values[-1]
    for at, value in zip((0.5, 0.95), q["price"][1:3], strict=True):
        assert abs(sum(v <= value for v in values) / len(values) - at) < 0.03


def test_decisions_are_those_of_exact_counts(spark):
    rng = random.Random(6)
    share = (0.01, 0.25, 0.295, 0.3, 0.305, 0.35, 1.0)
    rows = [(i, *[f"v{rng.randrange(max(1, int(3000 * s)))}" if s < 1 else f"v{i}" for s in share]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"t{k} string" for k in range(len(share))))
    found = sk.classify(df, sk.sketched(df, F.pmod("id", F.lit(5))))
    assert found == profile.classify(df)
    assert sk.merged(sk.sketched(df.limit(0), F.lit(1))).count() == 0
