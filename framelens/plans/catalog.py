"""Where queries register themselves, with the SQL that DuckDB runs for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelens.plans.views import VIEWS, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable:
    """Register a function (spark, sf_dir) under its name; ``sql`` may use the stand-in views that are named."""
    for v in views:
        assert v in VIEWS, v

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        assert f.__name__ not in QUERIES, f.__name__
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return f

    return register
