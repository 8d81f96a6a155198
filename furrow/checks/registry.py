"""Registry of checked queries: a Spark callable each, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.checks.compare import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = 6):
    """Register ``fn(spark, sf_dir)`` under ``name``; without ``digits`` its fractions are left as they are."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def with_(*ctes: str, body: str, recursive: bool = False) -> str:
    """One statement from named parts."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(c.strip() for c in ctes) + "\n" + body.strip()
