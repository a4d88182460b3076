"""The registered queries against DuckDB on the smallest tables, the entry and the command line."""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from weftline import catalog
from weftline.functions import completion
from weftline.__main__ import main

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def shown(value):
    if value is None or str(value) in ("nan", "NaT", "<NA>"):
        return "null"
    return repr(round(float(value), 5)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(got.columns)
    want = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert sorted(tuple(map(shown, r)) for r in rows) == sorted(tuple(map(shown, r)) for r in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_stands_without_the_training_operators(tmp_path, pipeline):
    """A copy without the subpackage, with the pipeline's file or without it, still imports and lists its queries."""
    for path in (ROOT / "weftline").rglob("*.py"):
        part = path.relative_to(ROOT)
        if "llm" not in part.parts:
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(path.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        (tmp_path / "corpus_pipeline.py").write_text((ROOT / "corpus_pipeline.py").read_text())
    code = "import __spark_entry__ as e; e.oracle_sql(); print(*e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
    assert sorted(said.stdout.split()) == sorted(catalog.queries())


def test_nothing_else_imports_the_training_operators():
    for path in (ROOT / "weftline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"weftline\.llm|from weftline import .*llm", path.read_text()), path


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "ann"), (2, "bob")], "id int, name string").write.parquet(str(tmp_path / "in"))
    shared = ["--collection", str(tmp_path / "c"), "--strategy", str(tmp_path / "s")]
    main([*shared, "forward", str(tmp_path / "in")])
    main([*shared, "reverse", str(tmp_path / "out")])
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["ann", "bob"]
    capsys.readouterr()
    main([*shared, "ask", "where is bob"])
    assert json.loads(capsys.readouterr().out)["citations"][0]["rowid"] == "2"


def test_retries(spark):
    tries, waits = [], []

    def flaky(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise OSError("busy")
        return "ok"

    assert completion.with_retries(flaky, "p", wait=waits.append) == "ok" and waits == [1.5, 3.0]
    rows = spark.createDataFrame([("a",), ("b",)], "prompt string")
    got = completion.complete_batch(rows, lambda: str.upper).collect()
    assert sorted((r["answer"], r["error"]) for r in got) == [("A", None), ("B", None)]
