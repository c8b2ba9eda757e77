"""Distinct counts of equal numbers, and deletions beside the stream's batches."""

from harmonium.operators.aggregates import distinct_counts
from harmonium.streaming.submissions import RatingStore


def test_signed_zero_and_nan_are_not_values(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (1.5,), (None,)], "x double")
    assert distinct_counts(df).first().distinct_values == 2


def test_a_batch_does_not_undo_a_deletion(spark, tmp_path):
    store = RatingStore(spark, str(tmp_path / "store"))
    schema = "user_id string, submitted_at timestamp, submission_id bigint, ratings array<struct<artist_id: bigint, rank: int>>"
    import datetime as dt

    old = spark.createDataFrame([("u", dt.datetime(2020, 1, 1), 1, [(1, 1)])], schema)
    other = spark.createDataFrame([("v", dt.datetime(2020, 1, 2), 2, [(2, 1)])], schema)
    store.save(old, 1)
    store.delete(spark.createDataFrame([("u",)], "user_id string"), 2)
    store.save(other, 2)
    assert [r.user_id for r in store.load().collect()] == ["v"]


def test_auc_of_very_small_scores_and_exact_ties(spark):
    from harmonium.operators import factors, metrics, scoring

    users = spark.createDataFrame([(1, [1e-6, 0.0], 5.0), (2, [0.0, 1.0], 0.0)], "userID int, factors array<double>, bias double")
    items = spark.createDataFrame([(i, [1e-4 * i, 0.1], 0.0) for i in (1, 2, 3)], "artistID int, factors array<double>, bias double")
    truth = spark.createDataFrame([(1, 3), (2, 1)], "userID int, artistID int")
    got = {r.userID: r.auc for r in scoring.user_auc(users, items, truth).collect()}
    assert got == {1: 1.0, 2: 0.5}
    value = factors.FactorModel(users, items).evaluate(truth, (metrics.AUC(), metrics.RecallAtK(3)), 3)
    assert {r.metric: r.value for r in value.collect()} == {"auc": 0.75, "recall@3": 1.0}


def test_auc_ties_across_blocks_have_the_same_bits(spark, monkeypatch):
    import random

    from harmonium.operators import scoring

    monkeypatch.setattr(scoring, "USER_BLOCK", 3)
    monkeypatch.setattr(scoring, "ITEM_BLOCK", 2)
    rng = random.Random(5)
    same = [rng.gauss(0, 1e-5) for _ in range(33)]
    users = spark.createDataFrame([(u, [rng.gauss(0, 1) for _ in same]) for u in range(8)], "userID int, factors array<double>")
    items = spark.createDataFrame([(i, same) for i in range(11)], "artistID int, factors array<double>")
    truth = spark.createDataFrame([(u, u) for u in range(8)], "userID int, artistID int")
    assert {r.auc for r in scoring.user_auc(users, items, truth).collect()} == {0.5}


def test_a_new_checkpoint_does_not_replace_older_batches(spark, tmp_path):
    import json

    from harmonium.streaming import submissions

    store = RatingStore(spark, str(tmp_path / "store"))
    for i, user in enumerate(["u", "v"]):
        folder = tmp_path / f"in{i}"
        folder.mkdir()
        line = {"submission_id": i, "user_id": user, "submitted_at": "2024-01-01T00:00:00Z", "ratings": [{"artist_id": 1, "rank": 1}]}
        (folder / "a.json").write_text(json.dumps(line))
        for _ in range(2):
            submissions.run_store(submissions.stream_submissions(spark, str(folder)), [1], store, str(tmp_path / f"check{i}")).awaitTermination()
    assert sorted(r.user_id for r in store.load().collect()) == ["u", "v"]
    assert store.compact(str(tmp_path / "compact")).load().count() == 2
