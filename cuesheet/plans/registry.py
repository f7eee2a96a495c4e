"""All registered queries over the reference's own operators, and their DuckDB equivalents.

A plan module declares its queries with ``@query(name, views, sql)``: the function gets a loader of tables and views and
returns a DataFrame; ``sql`` is the DuckDB text after the ``WITH`` clause of the views (it may go on with more common
table expressions, starting with a comma).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..sources import views

MODULES = ["accounts", "segments", "intervals", "folds", "text", "memory", "media", "streams", "corpora"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return views.load(self.spark, self.sf_dir, name)


def query(name: str, needs: str = "", sql: str | None = None):
    def put(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            head = views.ctes(*needs.split()) if needs else ""
            _ORACLE[name] = f"{head}\n{sql.strip()}" if head else re.sub(r"^\s*,", "WITH ", sql).strip()
        return f

    return put


def _all() -> None:
    for m in MODULES:
        import_module(f"cuesheet.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_ORACLE)
