"""Queries by name, each with the SQL that gives the same rows where there is such."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridsmith.session import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ["registry", "relational", "ranking", "expressions", "search", "upserts", "scoring", "extraction", "crawling", "streams", "records"]


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under a name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return add


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    for m in MODULES:
        importlib.import_module(f"gridsmith.plans.{m}")
    return dict(_QUERIES), dict(_SQL)
