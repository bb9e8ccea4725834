"""Registry of named queries: each is a lazy DataFrame job over the driver
tables, optionally paired with DuckDB SQL computing the same answer."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wicketlake.plans.oracle import with_views
from wicketlake.sources.tables import Tables

QueryFn = Callable[[Tables], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

# Modules whose import registers queries, in section order.
_MODULES = (
    "q_sources", "q_predicates", "q_joins", "q_aggregates", "q_windows", "q_functions", "q_streaming", "q_quality", "q_ml", "q_documents",
    "q_selection", "q_jobs",
)


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is the
    oracle body (views are prefixed automatically)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return deco


def _load() -> None:
    for mod in _MODULES:
        importlib.import_module(f"wicketlake.plans.{mod}")


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn: QueryFn) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_queries() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, sql in _ORACLES.items()}
