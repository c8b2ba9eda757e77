"""Row selection and positions inside groups.

A window over a group places the whole group in one task.  Two rules keep that
bounded here: "first k rows" is written as a filter on ``row_number`` so that
Spark drops all but k rows per group before the shuffle, and full positions
are taken slice by slice once a group outgrows ``SLICE_ROWS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows one task may order on its own
SLICE_ROWS = 1_000_000

_DIGEST_SPACE = 1 << 24


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
               rank_col: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; the order must be total to be repeatable."""
    name = rank_col or "__position"
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn(name, position).filter(F.col(name) <= k)
    return kept if rank_col else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Distinct by key, keeping the first row of the given order."""
    return first_rows(df, keys, order)


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Sort and keep the first ``n`` rows of the whole table."""
    return df.orderBy(*order).limit(n)


def most_popular_track(df: DataFrame, artist_col: str = "artistID", popularity_col: str = "popularity",
                       tie_cols: Sequence[str] | None = None) -> DataFrame:
    """The most popular row of each artist; all rows of artists without any popularity."""
    ties = tie_cols
    if ties is None:
        rest = [c for c in df.columns if c not in (artist_col, popularity_col)]
        ties = sorted(rest, key=lambda c: c != "track_id")  # the track id first, where there is one
    known = df.filter(F.col(artist_col).isNotNull())
    rated = known.filter(F.col(popularity_col).isNotNull())
    best = first_rows(rated, [artist_col], [F.desc(popularity_col), *[F.asc_nulls_last(c) for c in ties]])
    unrated = known.filter(F.col(popularity_col).isNull())
    return best.unionByName(unrated.join(rated.select(artist_col).distinct(), artist_col, "left_anti").select(*df.columns))


def digest(*columns: Column | str, seed: int | str = "") -> Column:
    """A repeatable random order: md5 of the columns' text and a seed."""
    text = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", *text, F.lit(str(seed))))


def _slice(digest_col: str, slices: Column) -> Column:
    """Slice number of a digest; slices are consecutive in digest order."""
    head = F.conv(F.substring(digest_col, 1, 6), 16, 10).cast("bigint")
    return F.floor(head * slices / F.lit(_DIGEST_SPACE)).cast("int")


def positions(df: DataFrame, keys: Sequence[str], digest_col: str, ties: Sequence[str] = (),
              weight_col: str | None = None, start_col: str = "start", total_col: str = "total",
              largest: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Position (from 0) of each row in its group by (digest, ties), and the group's total.

    With ``weight_col`` a row takes as many positions as its weight.  Groups
    beyond ``slice_rows`` are cut into slices of their digest range: each slice
    is ordered on its own and shifted by the rows of the slices before it.
    ``largest`` is the biggest group's total when the caller knows it already.
    """
    weight = F.col(weight_col) if weight_col else F.lit(1).cast("bigint")
    order = [F.col(digest_col), *[F.asc_nulls_first(c) for c in ties]]
    sizes = df.groupBy(*keys).agg(F.sum(weight).alias("__size"))
    if largest is None:
        largest = sizes.agg(F.max("__size")).first()[0] or 0

    if largest <= slice_rows:
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        before = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({
            start_col: F.coalesce(F.sum(weight).over(before), F.lit(0)).cast("bigint"),
            total_col: F.sum(weight).over(whole).cast("bigint"),
        })

    # Only groups beyond slice_rows are listed, at most rows / slice_rows of them.
    slices = F.least(F.ceil(F.col("__size") / F.lit(slice_rows)), F.lit(_DIGEST_SPACE)).cast("bigint")
    if keys:
        crowded = sizes.filter(F.col("__size") > slice_rows).select(*keys, slices.alias("__slices"))
        sliced = _null_safe_join(df, crowded, keys)
    else:
        sliced = df.withColumn("__slices", F.lit(-(-largest // slice_rows)).cast("bigint"))
    sliced = sliced.withColumn("__slice", _slice(digest_col, F.coalesce("__slices", F.lit(1)))).drop("__slices")

    cells = sliced.groupBy(*keys, "__slice").agg(F.sum(weight).alias("__n"))
    across = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = across.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *keys, "__slice",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__n").over(across).cast("bigint").alias(total_col),
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = _null_safe_join(ranked, offsets, [*keys, "__slice"])
    return joined.withColumn(start_col, (F.col("__offset") + F.col("__inside")).cast("bigint")).select(
        *df.columns, start_col, total_col
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys where null equals null."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, "left").drop(*[f"__r_{k}" for k in keys])


def dense_index(df: DataFrame, id_col: str, index_col: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(id, index): distinct ids numbered 0..n-1 in digest order, without one global sort."""
    ids = df.select(id_col).filter(F.col(id_col).isNotNull()).distinct().withColumn("__digest", digest(id_col))
    numbered = positions(ids, [], "__digest", [id_col], start_col=index_col, total_col="__total", slice_rows=slice_rows)
    return numbered.select(id_col, index_col)


def lookup_index(requests: DataFrame, index: DataFrame, id_col: str, index_col: str) -> DataFrame:
    """Requests with their index, -1 for unknown ids."""
    return requests.join(index, id_col, "left").withColumn(index_col, F.coalesce(index_col, F.lit(-1).cast("bigint")))
