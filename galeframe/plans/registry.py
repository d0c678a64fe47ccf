"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable:
    """Register a query under its function's name; uses: views that its SQL reads, in the order of their definition."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            from galeframe.plans.views import with_views

            ORACLE_SQL[f.__name__] = with_views(uses, sql)
        return f

    return keep
