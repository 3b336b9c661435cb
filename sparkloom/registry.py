"""Queries over the reference operators and the SQL that checks each.

A query module registers with ``@query(sql)``; without SQL a query is checked by tests only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def load() -> None:
    """Import every query module."""
    from .plans import analytics_queries, exchange_queries, graph_queries, index_queries, learning_queries, maintenance_queries, policy_queries, ranking_queries, retrieval_queries, search_queries, sequence_queries, signal_queries, state_queries, text_queries, vector_queries  # noqa: F401


load()
