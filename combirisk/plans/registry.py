"""Registry of queries: a Spark callable and, where it fits, its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from combirisk.plans.check_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True, all_sources: bool = False):
    """Register ``fn(spark, sf_dir)``; ``sql`` may read the shared check views, with betweenness from every item if ``all_sources``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = with_views(sql, all_sources) if views else sql
        return fn

    return register
