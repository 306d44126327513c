"""Registered queries: a Spark callable each, and comparison SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` reads the same tables."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql.strip()
        return function

    return register


MODULES = [
    "rule_queries", "anomaly_queries", "message_queries", "outbox_queries",
    "report_queries", "warehouse_queries", "source_queries", "stream_queries",
]


def load_all() -> None:
    """Register the queries of MODULES; others add theirs beside them."""
    for name in MODULES:
        import_module(f"tidewatch.plans.{name}")


def own() -> list[str]:
    """Names of the queries that MODULES register."""
    return sorted(name for name, function in QUERIES.items() if function.__module__.startswith("tidewatch.plans."))
