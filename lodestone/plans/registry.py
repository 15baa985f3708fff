"""Collects the query modules' entries for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) function under ``name``, with its SQL twin if it has one."""

    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    from lodestone.plans import fact_queries, table_queries  # noqa: F401  register themselves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["usage_anti_join"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
