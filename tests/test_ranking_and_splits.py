import math

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harmonium.operators import quantiles, ranking, splits
from harmonium.sources.readers import StandardLoader

TRACKS = "artistID string, track_id int, popularity double"


@pytest.mark.parametrize("data, kept", [
    ([("a", 1, 10.0), ("a", 2, 50.0), ("b", 3, None), ("b", 4, None)], [2, 3, 4]),
    ([("x", 1, 30.0), ("x", 2, 80.0), ("x", 3, 50.0), ("y", 4, 90.0), ("y", 5, 20.0)], [2, 4]),
    ([("x", i, None) for i in range(5)], [0, 1, 2, 3, 4]),
    ([("z", 1, None), ("z", 2, 60.0), ("z", 3, None), ("z", 4, 40.0)], [2]),
    ([("t", 2, 5.0), ("t", 1, 5.0)], [1]),
    ([(None, 1, 5.0), ("a", 2, 1.0)], [2]),
    ([], []),
])
def test_most_popular_track(spark, data, kept):
    out = ranking.most_popular_track(spark.createDataFrame(data, TRACKS))
    assert out.columns == ["artistID", "track_id", "popularity"]
    assert sorted(r["track_id"] for r in out.collect()) == kept


def test_first_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = ranking.first_rows(df, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange


@pytest.mark.parametrize("slice_rows", [1_000_000, 7])
def test_positions_do_not_depend_on_slicing(spark, slice_rows):
    df = spark.range(300).select((F.col("id") % 4 * F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    df = df.withColumn("d", ranking.digest("v", seed=1)).withColumn("w", (F.col("v") % 3 + 1).cast("bigint"))
    got = ranking.positions(df, ["k"], "d", ["v"], weight_col="w", slice_rows=slice_rows).collect()
    for k in {r["k"] for r in got}:
        at = 0
        group = sorted((r for r in got if r["k"] == k), key=lambda r: (r["d"], r["v"]))
        for r in group:
            assert r["start"] == at
            at += r["w"]
        assert {r["total"] for r in group} == {at}


@pytest.mark.parametrize("slice_rows", [1_000_000, 10])
def test_dense_index(spark, slice_rows):
    ids = spark.range(200).select((F.col("id") % 120).alias("u"))
    got = rows(ranking.dense_index(ids, "u", "i", slice_rows))
    assert sorted(i for _, i in got) == list(range(120))
    assert got == rows(ranking.dense_index(ids, "u", "i"))
    found = ranking.lookup_index(spark.createDataFrame([(5,), (999,)], "u bigint"), ranking.dense_index(ids, "u", "i"), "u", "i")
    assert [r["i"] for r in found.orderBy("u").collect()][1] == -1


def sizes(n, test, val):
    t = math.ceil(n * test)
    v = math.ceil((n - t) * (val / (1 - test)))
    if v >= n - t:
        v = 0
    return n - t - v, t, v


@pytest.mark.parametrize("n", [3, 10, 85, 100, 170, 323])
@pytest.mark.parametrize("slice_rows", [1_000_000, 20])
def test_random_split_sizes(spark, n, slice_rows):
    df = spark.range(n).select(F.col("id").alias("userID"), F.lit(1).alias("artistID"))
    got = {r["split"]: r["count"] for r in splits.random_split(df, 0.15, 0.15, slice_rows=slice_rows).groupBy("split").count().collect()}
    train, test, val = sizes(n, 0.15, 0.15)
    assert (got.get("train", 0), got.get("test", 0), got.get("val", 0)) == (train, test, val)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(counts=st.lists(st.integers(1, 30), min_size=1, max_size=8), seed=st.integers(0, 1000))
def test_user_split_is_a_partition(spark, counts, seed):
    data = [(u, a, float(a)) for u, n in enumerate(counts) for a in range(n)]
    df = spark.createDataFrame(data, "userID int, artistID int, weight double")
    out = splits.user_stratified_split(df, 0.2, 0.1, seed, slice_rows=8).collect()
    assert sorted((r["userID"], r["artistID"], r["weight"]) for r in out) == sorted(data)
    for u, n in enumerate(counts):
        parts = [r["split"] for r in out if r["userID"] == u]
        expected = (n, 0, 0) if n < 3 else sizes(n, 0.2, 0.1)
        assert (parts.count("train"), parts.count("test"), parts.count("val")) == expected


@pytest.mark.parametrize("chunk", [65_536, 10])
def test_copies_are_dealt_like_rows(spark, chunk):
    data = [(1, 7, 1.0)] * 60 + [(1, 8, 2.0)] * 3 + [(2, 7, 1.0)] * 2
    df = spark.createDataFrame(data, "userID int, artistID int, weight double")
    out = splits.user_stratified_split(df, 0.2, 0.1, copy_chunk=chunk).collect()
    assert sorted((r["userID"], r["artistID"], r["weight"]) for r in out) == sorted(data)
    first = [r["split"] for r in out if r["userID"] == 1]
    assert (first.count("train"), first.count("test"), first.count("val")) == sizes(63, 0.2, 0.1)


def test_loader_split(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("userID"), F.col("id").alias("artistID"))
    train, test, val = StandardLoader(spark=spark).train_test_val_split(df, "user_stratified", 0.2, 0.1)
    assert (train.count(), test.count(), val.count()) == (14, 4, 2)
    with pytest.raises(ValueError):
        StandardLoader(spark=spark).train_test_val_split(df, "other")


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_percentiles_match_linear_interpolation(spark, limit):
    rng = np.random.default_rng(3)
    spread = rng.lognormal(3, 2, 3000).round(2)
    tied = rng.choice([1.0, 1.0, 1.0, 5.0, 9.0], 3000)
    data = [(int(i % 3 == 0), float(a), float(b)) for i, (a, b) in enumerate(zip(spread, tied))] + [(0, None, 2.0), (7, 1.5, None)]
    df = spark.createDataFrame(data, "k int, a double, b double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["column"], r["prob"]): r["value"] for r in quantiles.percentiles(df, ["a", "b"], probs, ["k"], limit).collect()}
    for k in (0, 1, 7):
        for i, c in enumerate("ab", 1):
            values = [d[i] for d in data if d[0] == k and d[i] is not None]
            for p in probs:
                assert got.get((k, c, p)) == (pytest.approx(np.quantile(values, p)) if values else None)


def test_overall_percentiles_by_narrowing(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).cast("double").alias("x"))
    got = {r["prob"]: r["value"] for r in quantiles.percentiles(df, ["x"], [0.25, 0.5, 0.75], limit=100).collect()}
    assert got == {0.25: 1249.75, 0.5: 2499.5, 0.75: 3749.25}
