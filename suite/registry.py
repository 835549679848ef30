"""Names, functions and SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suite.fixtures import Fixture, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register ``fn(fixture) -> DataFrame``, with the SQL that must agree, if any."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixture(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(*views, body=sql)
        return fn

    return register


def r6(column: Column | str) -> Column:
    """Rounded for comparison; adding zero removes a negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + value.replace("'", "''") + "'" for value in values) + "]"
