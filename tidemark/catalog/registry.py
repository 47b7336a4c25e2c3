"""Every registered query with, where SQL can say it, its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import plain_unions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def run(spark, sf):
            plain_unions(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register
