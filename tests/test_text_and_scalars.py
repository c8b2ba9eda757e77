from datetime import datetime

import pytest
from pyspark.sql import functions as F

from harmonium.functions import scalars, text
from harmonium.functions.similarity import indel_similarity, lcs_lengths, whole_score


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression("x").alias("y")).first()["y"]


@pytest.mark.parametrize("name, simple, full", [
    ("  The   Beatles ", "the beatles", "the beatles"),
    ("Beyoncé", "beyoncé", "beyonce"),
    ("AC/DC", "ac/dc", "ac dc"),
    ("Sigur Rós!", "sigur rós!", "sigur ros"),
    ("Straße", "straße", "strasse"),
    ("!!!", "!!!", ""),
    ("坂本 龍一", "坂本 龍一", "坂本 龍一"),
    (None, "", ""),
])
def test_normalisers(spark, name, simple, full):
    assert one(spark, name, text.simple_name) == simple
    assert one(spark, name, text.full_name) == full


def test_clean_name_drops_brackets(spark):
    assert one(spark, " Blur (Live) [UK] ", text.clean_name) == "blur live uk"
    assert one(spark, None, text.clean_name) is None


@pytest.mark.parametrize("genre, tags, joined", [("rock", "british|indie", "rock|british|indie"), (None, "a", "a"), ("a", None, "a"), (None, None, "")])
def test_pipe_concat(spark, genre, tags, joined):
    df = spark.createDataFrame([(genre, tags)], "g string, t string")
    assert df.select(text.pipe_concat("g", "t").alias("y")).first()["y"] == joined


def test_keyword_flags(spark):
    df = spark.createDataFrame([("british rock indie",), ("K-Pop Party",), ("therapy",), (None,)], "t string")
    out = df.select(*[c.alias(n) for n, c in text.keyword_flags("t").items()]).collect()
    assert len(out[0]) == 12
    assert (out[0]["genre_rock"], out[0]["geo_british"], out[0]["mood_sad"]) == (1, 1, 0)
    assert (out[1]["geo_asian"], out[1]["mood_happy"]) == (1, 1)
    assert out[2]["genre_hip_hop"] == 1  # keywords match inside words
    assert sum(out[3]) == 0


def test_safe_user_id(spark):
    assert one(spark, "a.b/c-1_é", text.safe_user_id) == "abc-1_é"


def test_dates(spark):
    at = one(spark, 1238536800000, scalars.from_epoch_ms, "bigint")
    assert at == datetime(2009, 3, 31, 22, 0)
    parts = spark.createDataFrame([(at,)], "x timestamp").select(*[c.alias(n) for n, c in scalars.date_parts("x").items()]).first()
    assert tuple(parts) == (22, 31, 1, 3)


def test_rank_weight(spark):
    df = spark.createDataFrame([(r,) for r in (1, 2, 10, 0, 11)], "r int")
    assert [round(x["w"], 6) for x in df.select(scalars.rank_weight("r").alias("w")).collect()] == [1.0, 0.9, 0.1, 0.5, 0.5]


def test_min_max_empty_range(spark):
    df = spark.createDataFrame([(3.0, 3.0, 3.0), (5.0, 0.0, 10.0), (None, 0.0, 1.0)], "x double, lo double, hi double")
    got = [r["y"] for r in df.select(scalars.min_max("x", F.col("lo"), F.col("hi"), 0.5).alias("y")).collect()]
    assert got == [0.5, 0.5, None]


def test_nan_is_missing(spark):
    assert one(spark, float("nan"), scalars.nan_to_null, "double") is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_against_dynamic_programming():
    import random

    import pandas as pd

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdéß日 ") for _ in range(rng.choice([0, 1, 3, 8, 20, 63, 64, 65, 130, 600]))) for _ in range(300)]
    left, right = pd.Series(words), pd.Series(words[::-1])
    assert lcs_lengths(left, right).tolist() == [lcs(a, b) for a, b in zip(left, right)]


def test_ratio_golden(spark):
    df = spark.createDataFrame([("bob marley", "jacob marley")], "a string, b string")
    got = df.select(indel_similarity(F.col("a"), F.col("b")).alias("s")).withColumn("n", whole_score(F.col("s"))).first()
    assert got["s"] == pytest.approx(18 / 22)
    assert got["n"] == 81
