"""Every query with SQL gives the rows that DuckDB gives; the entry point stands without the optional parts."""

import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return str([plain(x) for x in v])
    if isinstance(v, float | np.floating):
        return f"{float(v):.8g}"
    return str(v)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_optional_parts(tmp_path):
    code = "import sys\nfor m in ('tessella.llm', 'corpus_pipeline'): sys.modules[m] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
