"""One id space for the artists of two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmonium.operators import ranking
from harmonium.session import materialise


class ArtistIDMapper:
    """Unified ids: matched and unmatched first-source artists keep their id, the others get new ones.

    New ids continue after the largest known id (or ``start_id``), in digest
    order of the name.  The mapping is kept as two tables, never as a driver dictionary.
    """

    def __init__(self, start_id: int | None = None, slice_rows: int = ranking.SLICE_ROWS):
        self.start_id = start_id
        self.slice_rows = slice_rows
        self.lastfm_: DataFrame | None = None
        self.spotify_: DataFrame | None = None

    def fit(self, matched_artists_df: DataFrame, lastfm_artists_df: DataFrame, spotify_artists_df: DataFrame,
            lastfm_id_col: str = "artistID", spotify_id_col: str = "artist_name", matched_lastfm_col: str = "artistID",
            matched_spotify_col: str = "right_artist_name") -> "ArtistIDMapper":
        matched = matched_artists_df.select(
            F.col(matched_lastfm_col).cast("bigint").alias("lastfm_artist_id"),
            F.col(matched_spotify_col).cast("string").alias("spotify_artist_name"),
        ).dropna()
        own = lastfm_artists_df.select(F.col(lastfm_id_col).cast("bigint").alias("lastfm_artist_id")).dropna()
        start = self.start_id
        if start is None:
            start = (own.agg(F.max("lastfm_artist_id")).first()[0] or 0) + 1

        lastfm = own.union(matched.select("lastfm_artist_id")).distinct()
        self.lastfm_ = materialise(lastfm.withColumn("unified_artist_id", F.col("lastfm_artist_id")), "lastfm-map")

        taken = matched.groupBy("spotify_artist_name").agg(F.max("lastfm_artist_id").alias("unified_artist_id"))
        names = spotify_artists_df.select(F.col(spotify_id_col).cast("string").alias("spotify_artist_name")).dropna()
        new = names.distinct().join(taken.select("spotify_artist_name"), "spotify_artist_name", "left_anti")
        numbered = ranking.dense_index(new, "spotify_artist_name", "__n", self.slice_rows)
        fresh = numbered.select("spotify_artist_name", (F.col("__n") + F.lit(start)).alias("unified_artist_id"))
        self.spotify_ = materialise(taken.unionByName(fresh), "spotify-map")
        return self

    def export_mappings(self) -> tuple[DataFrame, DataFrame]:
        """(lastfm_artist_id, unified_artist_id) and (spotify_artist_name, unified_artist_id)."""
        if self.lastfm_ is None or self.spotify_ is None:
            raise RuntimeError("Must call fit() first")
        return self.lastfm_, self.spotify_

    def get_mapping_summary(self) -> DataFrame:
        """One row of counts over both sources and the id range."""
        lastfm, spotify = self.export_mappings()
        a = lastfm.groupBy("unified_artist_id").agg(F.count("*").alias("l"))
        b = spotify.groupBy("unified_artist_id").agg(F.count("*").alias("s"))
        both = a.join(b, "unified_artist_id", "full_outer")
        on_l, on_s = F.col("l").isNotNull(), F.col("s").isNotNull()
        return both.agg(
            F.count("*").alias("total_unified_ids"),
            F.coalesce(F.sum("l"), F.lit(0)).cast("bigint").alias("lastfm_artists"),
            F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("spotify_artists"),
            F.count_if(on_l & on_s).alias("matched_artists"),
            F.count_if(on_l & ~on_s).alias("unmatched_lastfm"),
            F.count_if(~on_l & on_s).alias("unmatched_spotify"),
            F.min("unified_artist_id").alias("min_id"),
            F.max("unified_artist_id").alias("max_id"),
        )

    def transform_dataframe(self, df: DataFrame, id_col: str, source: str,
                            unified_id_col: str = "unified_artist_id") -> DataFrame:
        """``df`` with the unified id of each row's source id; unknown ids give null."""
        if source not in ("lastfm", "spotify", "auto"):
            raise ValueError(f"Invalid source: {source}. Must be 'lastfm', 'spotify', or 'auto'")
        lastfm, spotify = self.export_mappings()
        out, found = df, []
        is_number = isinstance(df.schema[id_col].dataType, T.IntegralType)
        if source == "lastfm" or (source == "auto" and is_number):
            ids = lastfm.select(F.col("lastfm_artist_id").alias("__l"), F.col("unified_artist_id").alias("__ul"))
            out = out.join(ids, F.col(id_col).cast("bigint") == F.col("__l"), "left").drop("__l")
            found.append("__ul")
        if source in ("spotify", "auto"):
            ids = spotify.select(F.col("spotify_artist_name").alias("__s"), F.col("unified_artist_id").alias("__us"))
            out = out.join(ids, F.col(id_col).cast("string") == F.col("__s"), "left").drop("__s")
            found.append("__us")
        return out.withColumn(unified_id_col, F.coalesce(*found)).drop(*found)

    def source_ids(self, df: DataFrame, unified_col: str, target_source: str, output_col: str) -> DataFrame:
        """``df`` with the source id of each unified id; unknown ids give null."""
        lastfm, spotify = self.export_mappings()
        if target_source == "lastfm":
            ids = lastfm.groupBy(F.col("unified_artist_id").alias("__u")).agg(F.max("lastfm_artist_id").alias(output_col))
        elif target_source == "spotify":
            ids = spotify.groupBy(F.col("unified_artist_id").alias("__u")).agg(F.max("spotify_artist_name").alias(output_col))
        else:
            raise ValueError(f"Invalid target_source: {target_source}. Must be 'lastfm' or 'spotify'")
        return df.join(ids, F.col(unified_col) == F.col("__u"), "left").drop("__u")

    def get_unified_id(self, source_id: int | str, source: str = "auto") -> int | None:
        """One lookup; use ``transform_dataframe`` for many."""
        spark = self.export_mappings()[0].sparkSession
        kind = "BIGINT" if isinstance(source_id, int) else "STRING"
        if source == "lastfm" and kind == "STRING":
            return None
        row = self.transform_dataframe(spark.createDataFrame([(source_id,)], f"id {kind}"), "id", source).first()
        return row["unified_artist_id"]

    def get_source_id(self, unified_id: int, target_source: str) -> int | str | None:
        """One lookup; use ``source_ids`` for many."""
        spark = self.export_mappings()[0].sparkSession
        request = spark.createDataFrame([(unified_id,)], "id BIGINT")
        return self.source_ids(request, "id", target_source, "source_id").first()["source_id"]
