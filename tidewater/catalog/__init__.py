"""Named queries bound to the driver tables, each with an ANSI/DuckDB
oracle statement.

Every entry takes ``(spark, root)`` where ``root`` holds
``<table>.parquet`` files and returns a lazy DataFrame.  The oracle SQL
reads the same tables as views and must return the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle statement (None when
    the operator has no SQL form)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every binding module so the registries are filled."""
    from tidewater.catalog import customers, star, panel, housing, figures, metrics, models, series  # noqa: F401
