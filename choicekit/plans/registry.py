"""Query registry: ``queries()`` and ``oracle_sql()`` for the driver.

Each query module registers ``name -> fn(spark, sf_dir) -> DataFrame`` and,
where the operator has an SQL equivalent, the DuckDB text that must produce the
same rows, columns and values.
"""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}

MODULES = ("q_reshape", "q_text", "q_vectors", "q_graph", "q_entities",
           "q_encode", "q_metrics", "q_udf", "q_scorer", "q_flows")


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
