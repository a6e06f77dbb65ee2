import importlib.util
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import lumenfold
import pytest
from lumenfold.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, oracle, name):
    got = QUERIES[name](spark, sf)
    want = oracle.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda it: sorted((tuple(map(plain, r)) for r in it), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry_module(spark):
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["event", "n", "name", "unique_name"]


def test_nothing_else_imports_the_optional_part():
    root = Path(lumenfold.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace("llm_classify", ""), p


def test_entry_without_the_optional_part(tmp_path):
    """With the training-data folders deleted and only the pipeline file left, all else is registered."""
    root = Path(lumenfold.__file__).parents[1]
    ignored = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.parquet")
    shutil.copytree(root / "lumenfold", tmp_path / "lumenfold", ignore=ignored)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and set(s) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(QUERIES), out.stderr


def test_distance_joins_plan_no_pairs(spark, sf):
    for name in ("reverse_geocode_tiered", "gps_nearest_good", "hamming_nearest", "asof_nearest", "sessionize"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
