"""Names of the queries, their Spark form and their SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airmon.catalog.proxy import Proxy, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of the proxy tables under its own name or the given one."""
    def add(fn: Callable[[Proxy], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Proxy(spark, sf_dir))

        QUERIES[name or fn.__name__] = run
        if sql:
            ORACLES[name or fn.__name__] = with_views(sql)
        return fn

    return add
