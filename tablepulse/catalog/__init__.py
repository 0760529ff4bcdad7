"""Registered queries: each operator and report over the given tables, with reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablepulse.catalog.tables import Tables, with_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under a name, with SQL for the same result."""
    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_views(sql)
        return function

    return register


def load() -> None:
    from tablepulse.catalog import (  # noqa: F401
        cost_queries,
        drift_queries,
        expression_queries,
        healing_queries,
        job_queries,
        layer_queries,
        quality_queries,
        registry_queries,
        relational_queries,
        report_queries,
        round_trip_queries,
        schema_queries,
        stream_queries,
    )


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(function: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: function(Tables(spark, folder))

    return {name: bind(function) for name, function in QUERIES.items()}


def reference_sql() -> dict[str, str]:
    load()
    return dict(SQL)
