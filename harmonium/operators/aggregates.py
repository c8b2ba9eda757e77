"""Grouped and whole-table aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmonium.operators import quantiles

AUDIO_COLUMNS = (
    "danceability", "energy", "valence", "tempo", "acousticness", "instrumentalness", "liveness", "speechiness",
)


class ArtistListenerCounter:
    """Distinct listeners per artist."""

    def __init__(self, user_id: str = "userID", artist_id: str = "artistID", approximate: bool = False):
        self.user_id = user_id
        self.artist_id = artist_id
        self.approximate = approximate

    def transform(self, df: DataFrame) -> DataFrame:
        count = F.approx_count_distinct if self.approximate else F.countDistinct
        return df.groupBy(self.artist_id).agg(count(self.user_id).alias("num_listeners"))


class TagAggregator:
    """Distinct tags per key, sorted and joined with pipes."""

    def __init__(self, group_by: str, tag_col: str = "tagValue", output_col: str = "aggregated_tags"):
        self.group_by = group_by
        self.tag_col = tag_col
        self.output_col = output_col

    def transform(self, df: DataFrame) -> DataFrame:
        # distinct first: repeated tags of a crowded key never reach the collecting task
        tags = df.select(self.group_by, F.col(self.tag_col).cast("string").alias(self.tag_col)).dropna().distinct()
        joined = F.array_join(F.sort_array(F.collect_list(self.tag_col)), "|")
        return tags.groupBy(self.group_by).agg(joined.alias(self.output_col))


def artist_statistics(df: DataFrame, artist_col: str = "artistID", columns: Sequence[str] = AUDIO_COLUMNS,
                      popularity_col: str | None = "popularity", count_col: str = "track_name",
                      limit: int = quantiles.BUFFER_VALUES) -> DataFrame:
    """mean, median, min, max and sample std of each column per artist, and the number of tracks."""
    targets = [*columns, *([popularity_col] if popularity_col else [])]
    largest = quantiles.largest_group(df, [artist_col])
    aggregates = []
    for c in targets:
        aggregates += [F.avg(c).alias(f"{c}_mean")]
        aggregates += [F.median(c).alias(f"{c}_median")] if largest <= limit else []
        aggregates += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.stddev_samp(c).alias(f"{c}_std")]
    known = df.filter(F.col(artist_col).isNotNull())
    stats = known.groupBy(artist_col).agg(*aggregates, F.count(count_col).alias("num_tracks"))
    if largest > limit:
        medians = quantiles.percentiles(known, targets, [0.5], [artist_col], limit)
        wide = medians.groupBy(artist_col).agg(
            *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"{c}_median") for c in targets])
        stats = stats.join(wide, artist_col, "left")
    ordered = [f"{c}_{s}" for c in targets for s in ("mean", "median", "min", "max", "std")]
    return stats.select(artist_col, *ordered, "num_tracks")


def artist_popularity(df: DataFrame, artist_col: str = "artistID", popularity_col: str = "popularity") -> DataFrame:
    return df.filter(F.col(artist_col).isNotNull()).groupBy(artist_col).agg(F.max(popularity_col).alias(popularity_col))


def user_ranges(df: DataFrame, user_col: str = "userID", weight_col: str = "weight") -> DataFrame:
    return df.groupBy(user_col).agg(F.min(weight_col).alias("min_weight"), F.max(weight_col).alias("max_weight"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, share), most nulls first."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count("*").alias("__rows"))
    tall = wide.unpivot(["__rows"], df.columns, "column", "nulls")
    share = F.try_divide(F.col("nulls").cast("double"), F.col("__rows").cast("double"))
    return tall.select("column", "nulls", share.alias("share")).orderBy(F.desc("nulls"), "column")


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """(value, n, share), most frequent first; the share is of the counted rows."""
    rows = df.filter(F.col(column).isNotNull()) if dropna else df
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").cast("double")).scalar()
    share = F.try_divide(F.col("n").cast("double"), total)
    return counts.withColumn("share", share).orderBy(F.desc("n"), "value")


def count_of_counts(df: DataFrame, column: str) -> DataFrame:
    """(n, keys): how many keys occur n times."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__key")).agg(F.count("*").alias("n"))
    return counts.groupBy("n").agg(F.count("*").alias("keys"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct_values), nulls not counted.

    Distinct (column, value) pairs are formed first, which combines before
    the shuffle and spreads one column's values over all tasks.  -0.0 and 0.0
    are one value, NaN is a missing one.
    """
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)

    def value(c: str):
        plain = F.when(~F.isnan(c), F.col(c) + F.lit(0).cast(kinds[c])) if kinds[c] in ("float", "double") else F.col(c)
        return plain.cast("string").alias(c)

    cells = df.select(*[value(c) for c in columns]).unpivot([], columns, "column", "value")
    pairs = cells.filter(F.col("value").isNotNull()).distinct().groupBy("column").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column STRING")
    return names.join(pairs, "column", "left").select("column", F.coalesce("n", F.lit(0)).cast("bigint").alias("distinct_values"))


def quantile_report(df: DataFrame, column: str, probs: Sequence[float] = (0.25, 0.5, 0.75),
                    limit: int = quantiles.BUFFER_VALUES) -> DataFrame:
    """(stat, value): exact quantiles and the mean of one column."""
    cuts = quantiles.percentiles(df, [column], probs, limit=limit)
    rows = cuts.select(F.concat(F.lit("q"), F.round(F.col("prob") * 100).cast("int")).alias("stat"), "value")
    return rows.unionByName(df.agg(F.avg(column).alias("value")).select(F.lit("mean").alias("stat"), "value"))


def information_loss(df: DataFrame, matched: str, user_col: str = "userID") -> DataFrame:
    """(lost_fraction, users, share): how much of a user's rows fails ``matched``, over users with any match."""
    per_user = df.groupBy(user_col).agg(
        F.count("*").alias("__n"), F.count_if(F.coalesce(F.col(matched), F.lit(False))).alias("__kept"))
    survivors = per_user.filter(F.col("__kept") > 0)
    lost = (F.col("__n") - F.col("__kept")).cast("double") / F.col("__n")
    spread = survivors.groupBy(lost.alias("lost_fraction")).agg(F.count("*").alias("users"))
    total = spread.agg(F.sum("users").cast("double")).scalar()
    return spread.withColumn("share", F.try_divide(F.col("users").cast("double"), total))


def match_coverage(df: DataFrame, matched: str, user_col: str = "userID") -> DataFrame:
    """One row: rows, unmatched rows and share, users and users with any match."""
    hit = F.coalesce(F.col(matched), F.lit(False))
    per_user = df.groupBy(user_col).agg(F.count("*").alias("n"), F.count_if(hit).alias("kept"))
    totals = per_user.agg(
        F.sum("n").cast("bigint").alias("all_rows"),
        F.sum(F.col("n") - F.col("kept")).cast("bigint").alias("unmatched_rows"),
        F.count(user_col).alias("users"),
        F.count_if(F.col("kept") > 0).alias("surviving_users"),
    )
    return totals.withColumn("unmatched_share", F.try_divide(F.col("unmatched_rows").cast("double"), F.col("all_rows").cast("double")))


def pair_sums(df: DataFrame, user_col: str = "userID", item_col: str = "artistID", weight_col: str = "weight") -> DataFrame:
    """Weights of equal (user, item) pairs added up."""
    return df.groupBy(user_col, item_col).agg(F.sum(weight_col).alias(weight_col))
