"""Registered queries: name -> (function of a Model, SQL for DuckDB or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cut import on_workers
from .fixtures import Model, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Model under name; sql is what DuckDB runs on the same tables."""

    def put(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            on_workers(spark)
            return f(Model(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return put
