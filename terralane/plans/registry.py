"""Registered queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terralane.plans.fixtures import Layers, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(layers)`` under ``name`` with its DuckDB text."""
    def wrap(fn: Callable[[Layers], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Layers(spark, folder))
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn
    return wrap
