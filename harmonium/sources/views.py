"""The domain tables, derived from the star-schema and event tables of a data folder.

Each view exists twice: as a DataFrame for the operators and as SQL text for
the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """(userID, artistID, weight): quantity a customer bought from a supplier."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey)
        .groupBy(F.col("o_custkey").alias("userID"), F.col("l_suppkey").alias("artistID"))
        .agg(F.sum("l_quantity").alias("weight"))
    )


V_INTERACTIONS = """v_interactions AS (
  SELECT o.o_custkey AS userID, l.l_suppkey AS artistID, SUM(l.l_quantity) AS weight
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
  GROUP BY o.o_custkey, l.l_suppkey)"""


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    null = F.lit(None).cast("double")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.col("l_quantity").cast("bigint").cast("string")).alias("track_id"),
        F.col("l_suppkey").alias("artistID"),
        F.col("p_name").alias("track_name"),
        F.when((F.col("l_suppkey") % 5 == 0) | (F.col("l_returnflag") == "N"), null)
        .otherwise((F.floor("l_extendedprice") % 101).cast("double")).alias("popularity"),
        F.col("l_quantity").alias("tempo"),
        F.col("l_discount").alias("energy"),
        F.when(F.col("l_suppkey") % 7 == 0, null).otherwise(F.col("l_extendedprice")).alias("duration_ms"),
        (F.col("l_tax") - F.lit(0.04)).alias("loudness"),
        F.when(F.col("l_suppkey") % 11 < 10, null).otherwise(F.col("l_tax")).alias("explicit"),
        F.when(F.col("p_type") == "ECONOMY", "alt-rock").when(F.col("p_type") == "LARGE", "techno")
        .when(F.col("p_type") == "MEDIUM", "Hip-Hop").when(F.col("p_type") == "SMALL", "opera")
        .when(F.col("p_type") == "STANDARD", "J-Pop").alias("track_genre"),
    )


V_TRACKS = """v_tracks AS (
  SELECT CONCAT_WS('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR), CAST(l.l_partkey AS VARCHAR),
                   CAST(l.l_suppkey AS VARCHAR), CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR)) AS track_id,
    l.l_suppkey AS artistID, p.p_name AS track_name,
    CASE WHEN l.l_suppkey % 5 = 0 OR l.l_returnflag = 'N' THEN NULL
         ELSE CAST(FLOOR(l.l_extendedprice) % 101 AS DOUBLE) END AS popularity,
    l.l_quantity AS tempo, l.l_discount AS energy,
    CASE WHEN l.l_suppkey % 7 = 0 THEN NULL ELSE l.l_extendedprice END AS duration_ms,
    l.l_tax - CAST(0.04 AS DOUBLE) AS loudness,
    CASE WHEN l.l_suppkey % 11 < 10 THEN CAST(NULL AS DOUBLE) ELSE l.l_tax END AS explicit,
    CASE p.p_type WHEN 'ECONOMY' THEN 'alt-rock' WHEN 'LARGE' THEN 'techno' WHEN 'MEDIUM' THEN 'Hip-Hop'
      WHEN 'SMALL' THEN 'opera' WHEN 'STANDARD' THEN 'J-Pop' ELSE NULL END AS track_genre
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def tag_assignments(spark: SparkSession, folder: str) -> DataFrame:
    """(userID, artistID, tagValue, ts) from events; suppliers stand for artists."""
    n_artists = table(spark, folder, "supplier").count()
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("userID"),
        (F.col("event_id") % F.lit(n_artists)).alias("artistID"),
        F.when(kind == "signup", "british").when(kind == "purchase", "chill").when(kind == "click", "dance")
        .when(kind == "view", "Rock").alias("tagValue"),
        "ts",
    )


V_TAGS = """v_tags AS (
  SELECT user_id AS userID, event_id % (SELECT COUNT(*) FROM supplier) AS artistID,
    CASE event_type WHEN 'signup' THEN 'british' WHEN 'purchase' THEN 'chill' WHEN 'click' THEN 'dance'
      WHEN 'view' THEN 'Rock' ELSE NULL END AS tagValue, ts
  FROM events)"""


def names_right(spark: SparkSession, folder: str) -> DataFrame:
    """(name, artistID): distinct part names."""
    return (
        table(spark, folder, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("artistID"))
    )


V_NAMES_RIGHT = """v_names_right AS (
  SELECT p_name AS name, MIN(p_partkey) AS artistID FROM part GROUP BY p_name)"""


def named_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """(artist_name, track_id, price): parts under spelling variants of their names."""
    name, key = F.col("p_name"), F.col("p_partkey") % 5
    return table(spark, folder, "part").select(
        F.when(key == 0, F.upper(name)).when(key == 1, F.replace(name, F.lit(" "), F.lit("-")))
        .when(key == 2, F.expr("substring(p_name, 1, length(p_name) - 1)"))
        .when(key == 3, F.concat(F.lit("  "), name, F.lit(" ")))
        .otherwise(F.concat(F.lit("zz"), F.substring(name, 1, 3))).alias("artist_name"),
        F.col("p_partkey").alias("track_id"),
        F.col("p_retailprice").alias("price"),
    )


V_NAMED_TRACKS = """v_named_tracks AS (
  SELECT CASE p_partkey % 5 WHEN 0 THEN UPPER(p_name) WHEN 1 THEN REPLACE(p_name, ' ', '-')
      WHEN 2 THEN SUBSTRING(p_name, 1, LENGTH(p_name) - 1) WHEN 3 THEN CONCAT('  ', p_name, ' ')
      ELSE CONCAT('zz', SUBSTRING(p_name, 1, 3)) END AS artist_name,
    p_partkey AS track_id, p_retailprice AS price
  FROM part)"""


def names_left(spark: SparkSession, folder: str) -> DataFrame:
    return named_tracks(spark, folder).select("artist_name").distinct()


V_NAMES_LEFT = f"""{V_NAMED_TRACKS}, v_names_left AS (
  SELECT DISTINCT artist_name FROM v_named_tracks)"""


def survey_artists(spark: SparkSession, folder: str, size: int = 10) -> DataFrame:
    """(artist_id): the ten items with the most events, the fixed list a survey shows."""
    n_items = table(spark, folder, "embeddings").count()
    return (
        table(spark, folder, "events")
        .groupBy((F.col("event_id") % F.lit(n_items)).alias("artist_id"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .orderBy(F.desc("n"), F.desc(F.round("total", 4)), "artist_id")
        .limit(size)
        .select("artist_id")
    )


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, artist_id, rank): each user's survey artists by summed event value."""
    from pyspark.sql import Window

    n_items = table(spark, folder, "embeddings").count()
    totals = (
        table(spark, folder, "events")
        .groupBy("user_id", (F.col("event_id") % F.lit(n_items)).alias("artist_id"))
        .agg(F.round(F.sum("value"), 4).alias("total"))
        .join(F.broadcast(survey_artists(spark, folder)), "artist_id", "left_semi")
    )
    order = Window.partitionBy("user_id").orderBy(F.desc("total"), "artist_id")
    return totals.select("user_id", "artist_id", F.row_number().over(order).alias("rank"))


V_RATINGS = """item_events AS (
  SELECT user_id, event_id % (SELECT COUNT(*) FROM embeddings) AS artist_id, value FROM events),
v_survey AS (
  SELECT artist_id FROM item_events GROUP BY artist_id
  ORDER BY COUNT(*) DESC, ROUND(SUM(value), 4) DESC, artist_id LIMIT 10),
v_ratings AS (
  SELECT user_id, artist_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY total DESC, artist_id) AS INTEGER) AS rank
  FROM (SELECT user_id, artist_id, ROUND(SUM(value), 4) AS total FROM item_events
        WHERE artist_id IN (SELECT artist_id FROM v_survey) GROUP BY user_id, artist_id) t)"""


def item_factors(spark: SparkSession, folder: str) -> DataFrame:
    """(artistID, factors, bias) from the embeddings; the label stands for the bias."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("artistID"),
        F.col("embedding").cast("array<double>").alias("factors"),
        F.col("label").cast("double").alias("bias"),
    )


V_FACTORS = """v_factors AS (
  SELECT vec_id AS artistID, CAST(embedding AS DOUBLE[]) AS factors, CAST(label AS DOUBLE) AS bias FROM embeddings)"""
