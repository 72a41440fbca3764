"""All registered queries of the engine and the SQL that an independent engine runs for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the oracle's SQL where SQL can express it."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Imports every module that registers queries."""
    from . import catalog  # noqa: F401

    return QUERIES, ORACLE_SQL
