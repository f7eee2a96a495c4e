"""Every query with a DuckDB equivalent gives the same rows as it."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from cuesheet.plans import registry
from cuesheet.sources import views


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in views.BASE:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(name, spark, sf, con):
    got = registry.queries()[name](spark, sf)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(name, spark, sf):
    made = registry.queries()[name](spark, sf)
    assert len(set(made.columns)) == len(made.columns)
    assert len(made.collect()) > 0


def test_entry_without_the_corpus_operators(tmp_path):
    """Without both corpus folders and corpus_pipeline.py, or without the folders only, the other queries are all there."""
    top = Path(__file__).parents[2]
    for also_pipeline in (False, True):
        copy = tmp_path / str(also_pipeline)
        skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *["corpus_pipeline.py"] * also_pipeline)
        shutil.copytree(top, copy, ignore=skip)
        told = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), 'pipeline' in q)"
        env = {**os.environ, "PYTHONPATH": os.pathsep.join(p for p in sys.path if p and Path(p).resolve() != top)}
        done = subprocess.run([sys.executable, "-c", told], cwd=copy, env=env, capture_output=True, text=True)
        assert done.stdout.split() == [str(len(registry.queries())), "False"], done.stderr


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
