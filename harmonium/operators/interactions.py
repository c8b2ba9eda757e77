"""Indexed interactions, sparse item features and new-user preferences, as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmonium.operators import ranking
from harmonium.operators.aggregates import pair_sums
from harmonium.operators.cleaning import distinct_ids, numeric_columns
from harmonium.session import materialise


class InteractionMatrixBuilder:
    """User and artist indices over all parts, and interactions in index space."""

    def __init__(self, slice_rows: int = ranking.SLICE_ROWS):
        self.slice_rows = slice_rows
        self.user_map: DataFrame | None = None
        self.artist_map: DataFrame | None = None

    def fit(self, train_df: DataFrame, test_df: DataFrame, val_df: DataFrame) -> "InteractionMatrixBuilder":
        parts = [train_df, test_df, val_df]
        users = ranking.dense_index(distinct_ids(parts, "userID"), "userID", "user_idx", self.slice_rows)
        artists = ranking.dense_index(distinct_ids(parts, "artistID"), "artistID", "artist_idx", self.slice_rows)
        self.user_map = materialise(users, "user-map")
        self.artist_map = materialise(artists, "artist-map")
        return self

    def _fitted(self) -> tuple[DataFrame, DataFrame]:
        if self.user_map is None or self.artist_map is None:
            raise ValueError("Must call fit() before transform()")
        return self.user_map, self.artist_map

    def transform(self, df: DataFrame) -> DataFrame:
        """(user_idx, artist_idx, weight): the stored cells; rows with unknown ids are dropped."""
        users, artists = self._fitted()
        cells = pair_sums(df)  # first, so that repeated pairs are not joined
        return cells.join(users, "userID").join(artists, "artistID").select("user_idx", "artist_idx", "weight")

    def add_new_user_interactions(self, userID: object, survey_interactions: DataFrame,
                                  order_col: str | None = None) -> DataFrame:
        """(userID, artistID, artist_idx, weight) of one new user; unknown artists are ignored."""
        return self.new_user_preferences(survey_interactions.withColumn("userID", F.lit(userID)), order_col)

    def new_user_preferences(self, surveys: DataFrame, order_col: str | None = None) -> DataFrame:
        """The same for many users at once; an artist's last weight by ``order_col`` counts."""
        _, artists = self._fitted()
        order = F.struct(order_col, "weight") if order_col else F.col("weight")
        last = surveys.groupBy("userID", "artistID").agg(F.max_by("weight", order).alias("weight"))
        return last.join(artists, "artistID").select("userID", "artistID", "artist_idx", "weight")

    def get_artist_indices(self, artist_ids: DataFrame) -> DataFrame:
        """Requests with their artist index, -1 for unknown ids."""
        return ranking.lookup_index(artist_ids, self._fitted()[1], "artistID", "artist_idx")

    @property
    def n_users(self) -> int:
        return self._fitted()[0].count()

    @property
    def n_artists(self) -> int:
        return self._fitted()[1].count()


class ArtistFeaturesBuilder:
    """Artist features aligned to the artist map."""

    def __init__(self, artist_col: str = "artistID"):
        self.artist_col = artist_col
        self.feature_names: list[str] = []

    def _names(self, features: DataFrame) -> list[str]:
        self.feature_names = numeric_columns(features, exclude=[self.artist_col])
        return self.feature_names

    def fit_transform(self, spotify_new: DataFrame, artist_id_map: DataFrame) -> DataFrame:
        """(artistID, artist_idx, feature, value): non-zero cells; an artist without any has one row of nulls."""
        names = self._names(spotify_new)
        cells = spotify_new.select(self.artist_col, *[F.col(c).cast("double").alias(c) for c in names])
        cells = cells.unpivot([self.artist_col], names, "feature", "value").filter(F.col("value") != 0)
        return artist_id_map.join(cells, self.artist_col, "left")

    def dense(self, spotify_new: DataFrame, artist_ids: DataFrame) -> DataFrame:
        """(artistID, features): one vector per artist of ``artist_ids``, zeros where unknown."""
        names = self._names(spotify_new)
        vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
        known = spotify_new.select(self.artist_col, vector.alias("features"))
        zeros = F.array_repeat(F.lit(0.0), len(names))
        return artist_ids.select(self.artist_col).join(known, self.artist_col, "left").withColumn(
            "features", F.coalesce("features", zeros))

    def get_feature_vector(self, artistID: object, spotify_new: DataFrame) -> Sequence[float]:
        """One artist's vector; use ``dense`` for many."""
        kind = spotify_new.schema[self.artist_col].dataType
        request = spotify_new.sparkSession.range(1).select(F.lit(artistID).cast(kind).alias(self.artist_col))
        return self.dense(spotify_new, request).first()["features"]
