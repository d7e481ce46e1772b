"""Registered queries: a name, a DataFrame function over the tables, and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.session import tune
from kgspark.sources.tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    from kgspark.plans import augmenting, builds, contexts, files, graphs, measures, relational, texts, verbs  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Tables(tune(spark), folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def names_in(module: str) -> list[str]:
    """Names registered by one module of this package."""
    _load()
    return [n for n, fn in _QUERIES.items() if fn.__module__.endswith("." + module)]


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
