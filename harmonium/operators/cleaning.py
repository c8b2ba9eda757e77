"""Projection, filtering, missing values and set operations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


# -- projection ---------------------------------------------------------------

def harmonise(df: DataFrame, rename: Mapping[str, str], columns: Mapping[str, str]) -> DataFrame:
    """Rename, add missing columns as typed nulls and select ``columns`` (name -> type) in order."""
    renamed = df.withColumnsRenamed(dict(rename))
    present = set(renamed.columns)
    return renamed.select(*[
        (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name) for name, kind in columns.items()
    ])


def rename_and_drop(df: DataFrame, rename: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(dict(rename))


# -- filters ------------------------------------------------------------------

def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def keep_members(df: DataFrame, members: DataFrame, key: str, member_key: str | None = None) -> DataFrame:
    """Rows whose key is listed in ``members``."""
    listed = members.select(F.col(member_key or key).alias(key))
    return df.join(listed, key, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, key: str, member_key: str | None = None) -> DataFrame:
    """Rows whose key is not listed in ``members``."""
    listed = members.select(F.col(member_key or key).alias(key))
    return df.join(listed, key, "left_anti")


def above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.filter(F.col(column) > F.lit(threshold))


def equal_to(df: DataFrame, column: str, value: float) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def null_share_columns(columns: Iterable[str]) -> list[Column]:
    """One average of an is-null flag per column, for a single aggregate over the table."""
    return [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]


def null_shares(df: DataFrame) -> DataFrame:
    """(column, null_share) from one pass."""
    wide = df.agg(*null_share_columns(df.columns))
    return wide.unpivot([], wide.columns, "column", "null_share")


def drop_high_null_columns(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    shares = df.agg(*null_share_columns(df.columns)).first().asDict()
    return df.drop(*[c for c, share in shares.items() if share is not None and share > threshold])


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


# -- set operations -----------------------------------------------------------

def union_by_name(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_ids(tables: Sequence[DataFrame], column: str) -> DataFrame:
    """Distinct ids over several tables; each table is reduced before the union."""
    return reduce(DataFrame.union, [t.select(column).distinct() for t in tables]).distinct()


def key_set_counts(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """One row: keys on both sides, only left, only right."""
    a = left.select(F.col(key).alias("k"), F.lit(1).alias("l")).distinct()
    b = right.select(F.col(right_key or key).alias("k"), F.lit(1).alias("r")).distinct()
    both = a.join(b, "k", "full_outer")
    return both.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"),
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
    )


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows beyond the first of their kind; nulls are equal."""
    counts = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("__n"))
    return counts.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
