"""Registry of named queries and their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bandwatch.catalog.prelude import with_prelude
from bandwatch.sources.testbed import Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The same over a testbed whose tables may already be written.
FUNCTIONS: dict[str, Callable[[Testbed], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(testbed) -> DataFrame`` and, where one exists, equal SQL."""

    def register(fn: Callable[[Testbed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        FUNCTIONS[name] = fn
        QUERIES[name] = lambda spark, sf_dir: fn(Testbed(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_prelude(sql)
        return fn

    return register
