"""Registered queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonium.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked."""

    def register(make: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return make(tune(spark), folder.rstrip("/"))

        run.__name__ = make.__name__
        run.__doc__ = make.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return make

    return register


def with_views(*views: str) -> str:
    """The WITH clause of the given view texts, each named once."""
    return "WITH " + ",\n".join(views) + "\n"


def r(c: Column | str, digits: int = 6) -> Column:
    """A rounded double, for comparison across engines."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def known_id(c: str, name: str | None = None) -> Column:
    """A whole number with -1 for missing, so that no engine turns the column into floats."""
    return F.coalesce(F.col(c), F.lit(-1)).alias(name or c)
