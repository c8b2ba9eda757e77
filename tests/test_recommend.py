import math
import random

import numpy as np
import pytest
from pyspark.ml.recommendation import ALSModel
from conftest import rows
from pyspark.ml.evaluation import RankingEvaluator
from pyspark.sql import functions as F

from harmonium.operators import factors, metrics, scoring, tuning
from harmonium.sources.writers import Bundle, write_bundle


def test_metric_golden(spark):
    recs = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1)], "userID int, artistID int, rank int")
    truth = spark.createDataFrame([(1, 2), (1, 9), (1, 9), (3, 1)], "userID int, artistID int")
    users = {r["userID"]: r for r in metrics.per_user(recs, truth, 3).collect()}
    assert set(users) == {1, 3}  # users without true items do not count
    one = users[1]
    assert (one["precision"], one["recall"], one["map"]) == (pytest.approx(1 / 3), 0.5, 0.25)
    assert one["ndcg"] == pytest.approx(0.38685, abs=1e-5)
    assert tuple(users[3])[1:] == (0.0, 0.0, 0.0, 0.0)


def test_own_metrics(spark):
    class ReciprocalRank(metrics.RankingMetric):
        column = "mrr"

        def per_user(self, hits, n_true):
            return F.coalesce(F.lit(1.0) / F.get(hits, F.lit(0)), F.lit(0.0))

    class Nameless(metrics.RankingMetric):
        column = "other"

    recs = spark.createDataFrame([(u, i, i) for u in (1, 2, 3) for i in (1, 2, 3, 4)], "userID int, artistID int, rank int")
    truth = spark.createDataFrame([(1, 2), (1, 4), (2, 4), (3, 9), (4, 1)], "userID int, artistID int")
    asked = [ReciprocalRank(3), ReciprocalRank(4), metrics.PrecisionAtK(2), metrics.RecallAtK(4)]  # each with a k of its own
    assert dict(rows(metrics.evaluate(recs, truth, asked))) == {"mrr@3": 0.5 / 4, "mrr@4": (0.5 + 0.25) / 4, "precision@2": 0.5 / 4, "recall@4": 0.5}
    assert rows(ReciprocalRank(3).compute(recs, truth, 4)) == [("mrr@4", 0.75 / 4)]
    with pytest.raises(NotImplementedError):
        metrics.evaluate(recs, truth, [Nameless(3)])
    for wrong in ([], [ReciprocalRank(3), ReciprocalRank(3)], [metrics.AUC()]):
        with pytest.raises(ValueError):
            metrics.evaluate(recs, truth, wrong)


def test_reports(spark):
    recs = spark.createDataFrame([(1, 1, 1)], "userID int, artistID int, rank int")
    report = metrics.evaluation_report(recs, {"train": recs, "test": recs}, [metrics.RecallAtK(10)])
    assert rows(report) == [("test", "recall@10", 1.0), ("train", "recall@10", 1.0)]
    empty = metrics.evaluate(recs, recs.limit(0), [metrics.RecallAtK(10)]).first()
    assert empty["value"] is None


def test_comparison(spark):
    base = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "metric string, value double")
    best = spark.createDataFrame([("a", 0.6), ("b", 0.1)], "metric string, value double")
    assert rows(metrics.compare(base, best)) == [("a", 0.5, 0.6, pytest.approx(20.0)), ("b", 0.0, 0.1, None)]


def test_metrics_agree_with_spark(spark):
    rng = random.Random(1)
    recs = [(u, i, r + 1) for u in range(20) for r, i in enumerate(rng.sample(range(50), 10))]
    truth = [(u, i) for u in range(20) for i in rng.sample(range(50), rng.randint(1, 15))]
    a = spark.createDataFrame(recs, "userID int, artistID int, rank int")
    b = spark.createDataFrame(truth, "userID int, artistID int")
    lists = (
        a.groupBy("userID").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "artistID"))), lambda x: x["artistID"].cast("double")).alias("prediction"))
        .join(b.groupBy("userID").agg(F.collect_list(F.col("artistID").cast("double")).alias("label")), "userID"))
    got = dict(rows(metrics.evaluate(a, b)))
    for name, ours in (("precisionAtK", "precision@10"), ("recallAtK", "recall@10"), ("ndcgAtK", "ndcg@10")):
        assert RankingEvaluator(metricName=name, k=10).evaluate(lists) == pytest.approx(got[ours])
    assert all(0 <= v <= 1 for v in got.values())


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(4)
    users, items = rng.normal(size=(30, 6)), rng.normal(size=(70, 6))
    bias = rng.normal(size=70)
    u = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "userID int, factors array<double>")
    v = spark.createDataFrame([(i, v.tolist(), float(b)) for i, (v, b) in enumerate(zip(items, bias))], "artistID int, factors array<double>, bias double")
    return u, v, users @ items.T + bias


def test_top_items_over_many_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(scoring, "USER_BLOCK", 7)
    monkeypatch.setattr(scoring, "ITEM_BLOCK", 9)
    u, v, scores = small
    barred = [(r, int(i)) for r in range(30) for i in np.argsort(-scores[r])[:3]]
    exclude = spark.createDataFrame(barred, "userID int, artistID int")
    for ex, skip in ((None, 0), (exclude, 3)):
        got = scoring.top_items(u, v, 5, ex).collect()
        assert len(got) == 150
        for r in got:
            want = np.argsort(-scores[r["userID"]])[skip + r["rank"] - 1]
            assert (r["artistID"], r["score"]) == (want, pytest.approx(scores[r["userID"], want]))


def test_equal_scores_are_ordered_by_item(spark):
    u = spark.createDataFrame([(1, [1.0])], "userID int, factors array<double>")
    v = spark.createDataFrame([(i, [1.0]) for i in (5, 3, 9, 1)], "artistID int, factors array<double>")
    assert [r["artistID"] for r in scoring.top_items(u, v, 3).orderBy("rank").collect()] == [1, 3, 5]
    assert scoring.top_items(u, v, 10).count() == 4


def test_auc(spark, small, monkeypatch):
    monkeypatch.setattr(scoring, "USER_BLOCK", 11)
    monkeypatch.setattr(scoring, "ITEM_BLOCK", 16)
    u, v, scores = small
    rng = random.Random(2)
    truth = {r: rng.sample(range(70), rng.randint(1, 10)) for r in range(25)}
    df = spark.createDataFrame([(r, i) for r, items in truth.items() for i in items], "userID int, artistID int")
    got = {r["userID"]: r["auc"] for r in scoring.user_auc(u, v, df).collect()}
    assert set(got) == set(truth)
    for r, items in truth.items():
        rest = [i for i in range(70) if i not in items]
        want = np.mean([scores[r, p] > scores[r, n] for p in items for n in rest])
        assert got[r] == pytest.approx(want)


def test_survey_recommendations(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [0.0, 1.0], 0.0), (3, [0.9, 0.1], 0.0), (4, [0.1, 0.9], 0.0), (5, [0.0, 0.0], 5.0)], "artistID bigint, factors array<double>, bias double")
    names = spark.createDataFrame([(3, "Three"), (4, "Four")], "artistID bigint, artist_name string")
    survey = spark.createDataFrame([(1,), (2,)], "artist_id bigint")
    service = scoring.RecommendationService(items, names, survey)
    asked = spark.createDataFrame([("a", 1, 1), ("a", 2, 10), ("b", 2, 1), ("b", 99, 2), ("b", 3, 1)], "user_id string, artist_id bigint, rank int")
    vectors = {r["user_id"]: list(r["factors"]) for r in service.create_user_vector_from_survey(asked).collect()}
    assert vectors == {"a": pytest.approx([1.0 / 1.1, 0.1 / 1.1]), "b": [0.0, 1.0]}  # 3 and 99 are not in the survey
    got = rows(service.recommend_from_survey(asked, k=2).select("user_id", "rank", "artistID", "artist_name"))
    assert got == [("a", 1, 5, "Unknown Artist"), ("a", 2, 3, "Three"), ("b", 1, 5, "Unknown Artist"), ("b", 2, 4, "Four")]
    with pytest.raises(ValueError):
        service.recommend_from_survey(asked.filter("artist_id = 99"))


@pytest.fixture(scope="module")
def planted(spark):
    """Two groups of users, each listening to its own half of the items."""
    rng = random.Random(0)
    train, test = [], []
    for u in range(60):
        mine = [i for i in range(40) if i % 2 == u % 2]
        rng.shuffle(mine)
        train += [(u, i, 1.0) for i in mine[:10]]
        test += [(u, i, 1.0) for i in mine[10:]]
    kind = "userID int, artistID int, weight double"
    feats = spark.createDataFrame([(i, float(i % 2), float(1 - i % 2), 1.0) for i in range(40)], "artistID int, odd double, even double, one double")
    return spark.createDataFrame(train, kind), spark.createDataFrame(test, kind), feats


@pytest.mark.parametrize("loss, bucket_rows", [("warp", 200_000), ("bpr", 200_000), ("warp-kos", 200_000), ("warp", 60)])
def test_feature_model_learns_a_planted_taste(spark, planted, loss, bucket_rows):
    train, test, feats = planted
    model = factors.BaselineModel(no_components=4, loss=loss, learning_rate=0.2, epochs=6, bucket_rows=bucket_rows).fit(train, feats)
    got = dict(rows(model.evaluate(test, [metrics.PrecisionAtK(10)], 10)))
    # all 20 items of a user's half score alike; half of the user's list is held out
    assert got["precision@10"] > 0.4
    assert dict(rows(model.model_.auc(test)))["auc"] > 0.6


@pytest.mark.parametrize("bucket_rows", [40, 100_000])
def test_losses_without_item_features(spark, planted, bucket_rows):
    train, test, _ = planted
    found = {}
    for loss in factors.LOSSES:
        model = factors.BaselineModel(no_components=4, loss=loss, learning_rate=0.2, epochs=6, bucket_rows=bucket_rows).fit(train)
        found[loss] = sorted((r["artistID"], *r["factors"]) for r in model.model_.items.collect())
        assert dict(rows(model.model_.auc(test)))["auc"] > 0.6
        assert model.model_.users.count() == train.select("userID").distinct().count()
    assert len({str(v) for v in found.values()}) == len(factors.LOSSES)


def test_feature_model_is_repeatable(spark, planted):
    train, _, feats = planted
    a, b = (sorted(map(tuple, factors.BaselineModel(no_components=3, epochs=2).fit(train, feats).feature_embeddings.collect())) for _ in range(2))
    assert [r[0] for r in a] == ["even", "odd", "one"] and np.allclose([[*r[1], r[2]] for r in a], [[*r[1], r[2]] for r in b])


def test_a_user_split_over_buckets_has_one_vector(spark):
    train = spark.createDataFrame([(0, i, 1.0) for i in range(300)] + [(u, u % 50, 1.0) for u in range(1, 30)], "userID int, artistID int, weight double")
    feats = spark.createDataFrame([(i, float(i % 5), 1.0) for i in range(300)], "artistID int, a double, b double")
    model = factors.BaselineModel(no_components=3, epochs=2, bucket_rows=50).fit(train, feats).model_
    assert model.users.count() == 30 and model.users.filter("userID = 0").count() == 1


def test_collaborative_model(spark, planted, tmp_path):
    train, test, _ = planted
    model = factors.collaborative_model(train, no_components=4, epochs=5)
    recs = model.recommend(k=10, filter_items=train.select("userID", "artistID"))
    got = dict(rows(metrics.evaluate(recs, test, [metrics.PrecisionAtK(10)])))
    assert got["precision@10"] > 0.9
    report = model.evaluate_splits(train, test, test, [metrics.RecallAtK(10)])
    assert {r["split"] for r in report.collect()} == {"train", "val", "test"}
    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        Bundle(spark, path)
    write_bundle(path, {"users": model.users}, {"als": model.als})
    write_bundle(path, {"users": model.users.limit(1)}, parameters={"k": 3})
    first, last = Bundle(spark, path, 0), Bundle(spark, path)
    assert (first.table("users").count(), last.table("users").count()) == (60, 1)
    assert first.model("als", ALSModel).rank == 4 and first.names == ["als", "users"] and last.parameters == {"k": 3}
    for wrong in (lambda: last.table("als"), lambda: last.model("als", ALSModel), lambda: first.model("users", ALSModel)):
        with pytest.raises(KeyError):
            wrong()


def test_model_arguments(spark):
    with pytest.raises(ValueError):
        factors.BaselineModel(loss="other")
    with pytest.raises(ValueError):
        factors.BaselineModel().recommend()


def test_search(spark, planted, tmp_path):
    train, test, feats = planted

    def draw(rng):
        return {"no_components": rng.choice([2, 4]), "loss": "bpr", "learning_rate": rng.choice([0.1, 0.2]), "epochs": 1}

    search = tuning.ModelOptimizer(train, test, feats, draw=draw)
    search.optimize([metrics.NDCGAtK(10)], n_trials=2)
    values = [r["value"] for r in search.trials.collect()]
    assert len(values) == 2 and search.best_score == max(values)
    assert search.best_params["random_state"] == 42
    search.save(str(tmp_path / "run"))
    bundle = Bundle(spark, str(tmp_path / "run"))
    assert bundle.table("trials").count() == 2 and bundle.table("train").count() == train.count()
    assert bundle.parameters == {**search.best_params, "best_score": search.best_score, "metric": "ndcg@10", "direction": "maximize"}
    again = factors.load_model(bundle)
    assert rows(again.recommend(k=3)) == rows(search.best_model.recommend(k=3))
    assert {r["feature"] for r in bundle.table("feature_embeddings").collect()} == {"odd", "even", "one"}
    with pytest.raises(ValueError):
        tuning.ModelOptimizer(train, test, feats, optimization_metric="nope", draw=draw).optimize([metrics.NDCGAtK(10)], n_trials=1)


def test_search_space():
    rng = random.Random(0)
    for _ in range(50):
        p = tuning.draw_parameters(rng)
        assert p["no_components"] % 16 == 0 and 16 <= p["no_components"] <= 128
        assert 0.001 <= p["learning_rate"] <= 0.1 and 10 <= p["epochs"] <= 50 and p["loss"] in factors.LOSSES
        assert math.isfinite(p["learning_rate"])
