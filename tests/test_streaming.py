import json
from datetime import datetime

import pytest
from conftest import rows

from harmonium.operators.scoring import RecommendationService
from harmonium.streaming import recommend, submissions

SURVEY = [1, 2, 3]


def make(spark, *entries):
    data = [(i, user, datetime(2024, 1, 1, 0, minute), ratings) for i, (user, minute, ratings) in enumerate(entries)]
    return spark.createDataFrame(data, submissions.SUBMISSION_SCHEMA)


@pytest.mark.parametrize("user, ratings, reason", [
    ("u", [(1, 1), (2, 2)], None),
    ("", [(1, 1)], "user_id must have 1 to 100 characters"),
    ("x" * 101, [(1, 1)], "user_id must have 1 to 100 characters"),
    (None, [(1, 1)], "user_id must have 1 to 100 characters"),
    ("u", [], "1 to 10 ratings are required"),
    ("u", None, "1 to 10 ratings are required"),
    ("u", [(i, 1) for i in range(11)], "1 to 10 ratings are required"),
    ("u", [(1, 0)], "rank must be between 1 and 10"),
    ("u", [(1, 11)], "rank must be between 1 and 10"),
    ("u", [(1, None)], "rank must be between 1 and 10"),
    ("u", [(1, 1), (1, 2)], "Duplicate artist IDs found in ratings"),
    ("u", [(1, 1), (2, 1)], "Duplicate ranks found. Each artist must have a unique rank"),
    ("u", [(9, 1), (2, 2), (5, 3)], "Invalid artist IDs: [5, 9]"),
])
def test_validation(spark, user, ratings, reason):
    got = submissions.validate(make(spark, (user, 0, ratings)), SURVEY).first()
    assert (got["valid"], got["reason"]) == (reason is None, reason)


def test_ordered_lists(spark):
    df = spark.createDataFrame([("u", [7, 3])], "user_id string, artists array<int>")
    assert [tuple(r) for r in submissions.from_ordered_list(df).first()["ratings"]] == [(7, 1), (3, 2)]


def test_survey_size_is_checked(spark):
    assert submissions.survey_ids(spark.createDataFrame([(2,), (1,), (2,)], "artist_id int")) == [1, 2]
    with pytest.raises(ValueError):
        submissions.survey_ids(spark.range(5000).withColumnRenamed("id", "artist_id"))


def test_store(spark, tmp_path):
    store = submissions.RatingStore(spark, str(tmp_path / "store"))
    assert store.load().count() == 0
    store.save(make(spark, ("a", 1, [(1, 1)]), ("a", 5, [(2, 1)]), ("b", 2, [(3, 1)])), 0)
    store.save(make(spark, ("a", 3, [(3, 1)]), ("c", 4, [(1, 1)])), 1)
    store.save(make(spark, ("a", 3, [(3, 1)]), ("c", 4, [(1, 1)])), 1)  # a replayed batch

    def state(s):
        return {r["user_id"]: r["ratings"][0]["artist_id"] for r in s.load().collect()}

    assert state(store) == {"a": 2, "b": 3, "c": 1}
    asked = spark.createDataFrame([("a",), ("z",)], "user_id string")
    assert rows(store.has_ratings(asked)) == [("a", True), ("z", False)]
    store.delete(spark.createDataFrame([("b",)], "user_id string"), 2)
    assert state(store) == {"a": 2, "c": 1}
    assert state(store.compact(str(tmp_path / "compact"))) == {"a": 2, "c": 1}
    store.delete(spark.createDataFrame([("c",)], "user_id string"), 2)
    assert state(store) == {"a": 2} and len(store.live()) == 4
    reader = submissions.RatingStore(spark, str(tmp_path / "store"))
    assert state(store.compact()) == {"a": 2} == state(reader) and len(reader.live()) == 1
    store.save(make(spark, ("a", 3, [(3, 1)]), ("c", 4, [(1, 1)])), 1)  # replayed after the compaction
    store.save(make(spark, ("b", 2, [(3, 1)])), 0, "another run")  # older than the deletion
    assert state(reader) == {"a": 2} and len(reader.live()) == 2
    assert store.vacuum(keep=1) == 5 and state(reader) == {"a": 2} and store.vacuum(keep=1) == 0


def test_folded_epochs_are_ranges():
    ranges = []
    for epoch in (3, 1, 2, 7, 2, 0, 9, 8):
        ranges = submissions.with_epoch(ranges, epoch)
    assert ranges == [[0, 3], [7, 9]]


def test_store_with_two_writers(spark, tmp_path):
    one, two = (submissions.RatingStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.save(make(spark, ("a", 1, [(1, 1)])), 0, "x")
    one.save(make(spark, ("b", 1, [(1, 1)])), 1, "x")
    commit, late = one.manifest.commit, []

    def overtaken(change):
        if not late:  # while the compaction writes, the other writer commits
            late.append(two.save(make(spark, ("c", 1, [(1, 1)])), 0, "y"))
        return commit(change)

    one.manifest.commit = overtaken
    one.compact()
    assert {r["user_id"] for r in two.load().collect()} == {"a", "b", "c"} and len(two.live()) == 2
    lost = two.manifest.versions
    two.manifest.versions = lambda: lost()[:-1] if len(calls) < 1 and not calls.append(1) else lost()  # a stale look at the folder
    calls = []
    two.save(make(spark, ("d", 1, [(1, 1)])), 1, "y")
    assert {r["user_id"] for r in one.load().collect()} == {"a", "b", "c", "d"}


def test_a_new_checkpoint_at_the_same_path_overwrites_nothing(spark, tmp_path):
    store, inbox = submissions.RatingStore(spark, str(tmp_path / "store")), tmp_path / "inbox"
    inbox.mkdir()
    for turn, user in enumerate("ab"):
        line = {"submission_id": turn, "user_id": user, "submitted_at": "2024-01-01T00:00:00Z", "ratings": [{"artist_id": 1, "rank": 1}]}
        (inbox / f"{turn}.json").write_text(json.dumps(line))
        for _ in range(2):  # started again with the same checkpoint, a stream finds nothing new
            submissions.run_store(submissions.stream_submissions(spark, str(inbox)), SURVEY, store, str(tmp_path / "checkpoint")).awaitTermination()
        assert {r["user_id"] for r in store.load().collect()} == set("ab"[: turn + 1])
        assert len(store.live()) == turn + 1
        (inbox / f"{turn}.json").rename(tmp_path / f"{turn}.json")
        (tmp_path / "checkpoint").rename(tmp_path / f"checkpoint-{turn}")


def test_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    entries = [("a", 1, [(1, 1)]), ("b", 2, [(2, 1), (2, 2)]), ("a", 4, [(3, 2)]), ("c", 3, [(2, 1)]), ("a", 2, [(2, 1)])]

    def put(name, part):
        lines = [json.dumps({"submission_id": entries.index(e), "user_id": e[0], "submitted_at": f"2024-01-01T00:0{e[1]}:00Z",
                             "ratings": [{"artist_id": a, "rank": r} for a, r in e[2]]}) for e in part]
        (inbox / name).write_text("\n".join(lines))

    store = submissions.RatingStore(spark, str(tmp_path / "store"))
    for n, part in enumerate((entries[:3], entries[3:])):
        put(f"{n}.json", part)
        stream = submissions.stream_submissions(spark, str(inbox))
        submissions.run_store(stream, SURVEY, store, str(tmp_path / "checkpoint"), str(tmp_path / "rejected")).awaitTermination()
    batch = submissions.validate(make(spark, *entries), SURVEY).filter("valid")
    expected = submissions.latest_per_user(batch.select(*store.columns))
    assert sorted((r["user_id"], r["submission_id"]) for r in store.load().collect()) == sorted((r["user_id"], r["submission_id"]) for r in expected.collect())
    rejected = spark.read.parquet(str(tmp_path / "rejected"))
    assert [r["reason"] for r in rejected.collect()] == ["Duplicate artist IDs found in ratings"]


def test_recommendations(spark, tmp_path):
    items = spark.createDataFrame([(i, [float(i == 4), float(i == 5), 0.1 * i], 0.0) for i in range(1, 8)], "artistID bigint, factors array<double>, bias double")
    names = spark.createDataFrame([(7, "Seven")], "artistID bigint, artist_name string")
    service = RecommendationService(items, names, spark.createDataFrame([(i,) for i in SURVEY], "artist_id bigint"))
    latest = submissions.latest_per_user(make(spark, ("a", 1, [(1, 1), (3, 2)])))
    requests = spark.createDataFrame([("a",), ("z",)], "user_id string")
    out = recommend.generate_recommendations(requests, latest, service, 2).collect()
    mine = sorted((r["rank"], r["artistID"], r["artist_name"], r["status"]) for r in out if r["user_id"] == "a")
    assert mine == [(1, 7, "Seven", "ok"), (2, 6, "Unknown Artist", "ok")]
    assert [(r["status"], r["rank"]) for r in out if r["user_id"] == "z"] == [("No ratings found for user z. Please submit ratings first.", None)]
    with pytest.raises(ValueError):
        recommend.generate_recommendations(requests, latest, service, 51)

    store = submissions.RatingStore(spark, str(tmp_path / "store"))
    store.save(latest, 0)
    (tmp_path / "asked").mkdir()
    (tmp_path / "asked" / "r.json").write_text('{"user_id": "a"}')
    stream = spark.readStream.schema("user_id STRING").json(str(tmp_path / "asked"))
    recommend.run_recommendations(stream, store, service, str(tmp_path / "out"), str(tmp_path / "ck"), 2).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
