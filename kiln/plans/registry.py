"""Registry of named queries: Spark plan + DuckDB oracle SQL (optional)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: tuple[str, ...] | str = (), sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (ids,) if isinstance(ids, str) else tuple(ids))
        return fn

    return deco
