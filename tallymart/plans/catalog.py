"""Registry of runnable queries and, where SQL can state them, their oracle text."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymart.plans.demo import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_AREAS = ["reports", "metrics", "stock", "prices", "ingestion", "search", "admin", "streams"]


def query(name: str, views: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle over the views named in ``views``."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for area in _AREAS:
        importlib.import_module(f"tallymart.plans.{area}")
    return QUERIES, ORACLES
