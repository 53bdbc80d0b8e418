"""The engine's queries by name, with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "cosine_topk"


def query(name: str, sql: str | None = None):
    """Register a query; sql is its oracle."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from tessera.plans import source_queries, text_queries, vector_queries  # noqa: F401
