"""Joins of the enrichment flow.

All of them are equi-joins against a side with one row per key, so a crowded
key on the large side is split by AQE without repeating work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN_ARTIST = "Unknown Artist"


class JoinTags:
    """Attach each artist's tag text to its tracks."""

    def __init__(self, id: str = "artistID", how: str = "left"):
        self.id = id
        self.how = how

    def transform(self, tracks: DataFrame, tags: DataFrame) -> DataFrame:
        return tracks.join(tags, self.id, self.how)


class JoinArtistListeners:
    """Attach listener counts to tracks."""

    def __init__(self, artist_id: str = "artistID", how: str = "left"):
        self.artist_id = artist_id
        self.how = how

    def transform(self, tracks: DataFrame, listeners: DataFrame) -> DataFrame:
        return tracks.join(listeners, self.artist_id, self.how)


def keep_known(interactions: DataFrame, known: DataFrame, key: str = "artistID") -> DataFrame:
    """Interactions whose artist has features."""
    return interactions.join(known.select(key), key, "left_semi")


def coverage(interactions: DataFrame, known: DataFrame, key: str = "artistID") -> DataFrame:
    """One row: all rows, kept rows and their ratio, from per-key counts."""
    counts = interactions.groupBy(key).agg(F.count("*").alias("__n"))
    flagged = counts.join(known.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    totals = flagged.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("all_rows"),
        F.coalesce(F.sum(F.when(F.col("__known"), F.col("__n"))), F.lit(0)).alias("kept_rows"),
    )
    return totals.withColumn("ratio", F.try_divide(F.col("kept_rows").cast("double"), F.col("all_rows").cast("double")))


def attach_unified_id(df: DataFrame, mapping: DataFrame, df_key: str, mapping_key: str,
                      unified_col: str = "unified_artist_id") -> DataFrame:
    """Left join of source rows to their unified id; copies stay, unmatched rows get null."""
    ids = mapping.select(F.col(mapping_key).alias(df_key), F.col("unified_artist_id").alias(unified_col))
    return df.join(ids, df_key, "left")


def artists_with_tracks(artists: DataFrame, tracks: DataFrame, key: str = "unified_artist_id") -> DataFrame:
    """All tracks of every artist; artists without tracks are kept."""
    return artists.join(tracks, key, "left")


def tracks_of_matches(tracks: DataFrame, matches: DataFrame, track_key: str, match_key: str) -> DataFrame:
    """Tracks whose name was matched."""
    return tracks.join(matches.dropna(subset=[match_key]), tracks[track_key] == matches[match_key])


def with_group_statistics(df: DataFrame, statistics: DataFrame, key: str) -> DataFrame:
    return df.join(statistics, key, "left")


def null_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(column, nulls) of ``left`` left-joined to ``right`` on ``key``.

    The join itself may be many-to-many.  Only its null counts are wanted, so
    both sides are counted per key first and at most one row per key meets.
    """
    lefts = [c for c in left.columns if c != key]
    rights = [c for c in right.columns if c != key]
    a = left.groupBy(key).agg(
        F.count("*").alias("l_n"), *[F.count_if(F.col(c).isNull()).alias(f"l_{i}") for i, c in enumerate(lefts)]
    )
    b = right.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("r_n"), *[F.count_if(F.col(c).isNull()).alias(f"r_{i}") for i, c in enumerate(rights)]
    )
    times = F.coalesce(F.col("r_n"), F.lit(1))
    sums = [F.sum(F.when(F.col(key).isNull(), F.col("l_n") * times).otherwise(F.lit(0))).alias(key)]
    sums += [F.sum(F.col(f"l_{i}") * times).alias(c) for i, c in enumerate(lefts)]
    sums += [
        F.sum(F.col("l_n") * F.coalesce(F.col(f"r_{i}"), F.lit(1))).alias(c if c not in lefts else f"{c}_right")
        for i, c in enumerate(rights)
    ]
    wide = a.join(b, key, "left").agg(*sums)
    return wide.unpivot([], wide.columns, "column", "nulls")


def lookup_name(ids: DataFrame, names: DataFrame, key: str = "artistID", name_col: str = "artist_name",
                default: str = UNKNOWN_ARTIST) -> DataFrame:
    """Ids with their name, or the default."""
    return ids.join(names.select(key, name_col), key, "left").withColumn(name_col, F.coalesce(name_col, F.lit(default)))
