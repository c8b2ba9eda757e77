"""File readers and the schemas of the known tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmonium.functions.scalars import nan_to_null
from harmonium.operators import splits

SCHEMAS = {
    "interactions": "userID BIGINT, artistID BIGINT, weight DOUBLE",
    "artists": "id BIGINT, name STRING, url STRING, pictureURL STRING",
    "tags": "tagID BIGINT, tagValue STRING",
    "user_taggedartists": "userID BIGINT, artistID BIGINT, tagID BIGINT, day INT, month INT, year INT",
    "user_taggedartists_timestamps": "userID BIGINT, artistID BIGINT, tagID BIGINT, timestamp BIGINT",
    "user_friends": "userID BIGINT, friendID BIGINT",
    "tracks": (
        "artist_name STRING, track_name STRING, popularity DOUBLE, duration_ms BIGINT, explicit BOOLEAN, "
        "danceability DOUBLE, energy DOUBLE, key INT, loudness DOUBLE, mode INT, speechiness DOUBLE, "
        "acousticness DOUBLE, instrumentalness DOUBLE, liveness DOUBLE, valence DOUBLE, tempo DOUBLE, "
        "time_signature INT, track_genre STRING"
    ),
    "rating_submission": "user_id STRING, ratings ARRAY<STRUCT<artist_id: BIGINT, rank: INT>>",
}


def _without_nan(df: DataFrame) -> DataFrame:
    """Missing numbers are null, never NaN."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",",
             encoding: str = "UTF-8") -> DataFrame:
    """Header file with doubled quotes; types are inferred only without a schema."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    reader = reader.option("quote", '"').option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return _without_nan(reader.csv(path))


def read_dat(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
             encoding: str = "ISO-8859-1") -> DataFrame:
    """Tab-separated file."""
    return read_csv(spark, path, schema, sep="\t", encoding=encoding)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _without_nan(spark.read.parquet(path))


def load_tag_assignments(assignments: DataFrame, tags: DataFrame) -> DataFrame:
    """Assignments with the text of their tag; unknown tags give null."""
    return assignments.join(tags, "tagID", "left")


class StandardLoader:
    """Load one file by its extension and split interactions."""

    def __init__(self, folder_path: str | None = None, spark: SparkSession | None = None,
                 schema: str | T.StructType | None = None):
        self.folder_path = folder_path
        self.schema = schema
        self._spark = spark

    def load(self) -> DataFrame:
        spark = self._spark or SparkSession.active()
        kind = str(self.folder_path).rstrip("/").rsplit(".", 1)[-1]
        if kind == "csv":
            return read_csv(spark, self.folder_path, self.schema)
        if kind == "dat":
            return read_dat(spark, self.folder_path, self.schema)
        if kind == "parquet":
            return read_parquet(spark, self.folder_path)
        raise ValueError(f"Unsupported file format - {kind}")

    def train_test_val_split(self, df: DataFrame, strategy: str = "random", test_size: float = 0.2,
                             val_size: float = 0.1, random_state: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(train, test, val), in that order; dealt once, then read three times."""
        parts = splits.assign_split(df, strategy, test_size, val_size, random_state)
        return tuple(
            parts.filter(F.col(splits.PART) == name).drop(splits.PART) for name in ("train", "test", "val")
        )
