"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from levelgrid.session import bound_broadcasts, bound_partitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# The tables that the scans and plans are derived from.
SOURCES = ["customer", "supplier", "part", "orders", "lineitem", "events"]


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def add(fn):
        @wraps(fn)
        def bounded(spark, sf_dir):
            bound_broadcasts(spark)
            bound_partitions(spark, [f"{sf_dir}/{t}.parquet" for t in SOURCES])
            return fn(spark, sf_dir)

        QUERIES[name] = bounded
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
