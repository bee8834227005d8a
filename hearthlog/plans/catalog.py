"""Registry of the runnable queries and their equivalent SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register `fn(spark, folder)` under `name`, with the SQL that must agree with it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        queries_aggregates,
        queries_functions,
        queries_joins,
        queries_retrieval,
        queries_sequence,
        queries_streams,
        queries_tables,
        queries_vectors,
    )
