"""Registered queries against their oracle SQL on the smallest tables, and the guard around the optional parts."""

import functools
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from lexispark.plans import catalog

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def cell(value):
    return "" if value is None or value != value else str(value)


@functools.cache
def oracle(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql)
    return [d[0] for d in want.description], sorted(tuple(map(cell, r)) for r in want.fetchall())


@needs_tables
@pytest.mark.parametrize("name", list(catalog.queries()))
def test_oracle(spark, name):
    got = catalog.queries()[name](spark, SF)
    columns, want = oracle(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(cell, r)) for r in got.select(columns).collect()) == want


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_of_the_engine_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("gone", [["lexispark/llm", "tests/llm"], ["lexispark/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_registry_with_parts_really_deleted(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "spark-warehouse"))
    for name in gone:
        (shutil.rmtree if (copy / name).is_dir() else os.remove)(copy / name) if (copy / name).exists() else None
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(k for k in e.queries() if k.startswith(('op', 'pipe'))))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n = len(catalog.queries())
    if "lexispark/llm" in gone:
        assert f"{n} {n} " in done.stdout and "op1_" not in done.stdout and "pipeline" not in done.stdout
    else:
        assert "pipeline" not in done.stdout
