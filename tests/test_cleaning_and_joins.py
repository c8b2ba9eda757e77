import pytest
from conftest import rows
from pyspark.sql import functions as F

from harmonium.operators import aggregates, cleaning, joins
from harmonium.sources import readers, writers


def test_harmonise_and_union(spark):
    a = spark.createDataFrame([("x", 1.0)], "artists string, popularity double")
    b = spark.createDataFrame([("y", "rock")], "artist_name string, genre string")
    columns = {"artist_name": "string", "popularity": "double", "track_genre": "string"}
    out = cleaning.union_by_name(cleaning.harmonise(a, {"artists": "artist_name"}, columns), cleaning.harmonise(b, {"genre": "track_genre"}, columns))
    assert out.columns == list(columns)
    assert rows(out) == [("x", 1.0, None), ("y", None, "rock")]


def test_membership(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    listed = spark.createDataFrame([(2,)], "k int")
    assert rows(cleaning.keep_members(df, listed, "k")) == [(2,), (2,)]
    assert cleaning.drop_members(df, listed, "k").count() == 2


def test_null_shares_and_drop(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2), (None, 3), (None, 4)], "a double, b int")
    assert rows(cleaning.null_shares(df)) == [("a", 0.75), ("b", 0.0)]
    assert cleaning.drop_high_null_columns(df, 0.6).columns == ["b"]
    assert cleaning.drop_high_null_columns(df, 0.75).columns == ["a", "b"]  # strictly more


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "b")], "a int, b string")
    assert cleaning.duplicate_rows(df).first()[0] == 1
    assert cleaning.duplicate_rows(df, ["a"]).first()[0] == 2
    assert cleaning.duplicate_rows(df.limit(0)).first()[0] == 0


def test_key_sets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert tuple(cleaning.key_set_counts(a, b, "k").first()) == (1, 1, 2)
    assert rows(cleaning.distinct_ids([a, b], "k")) == [(1,), (2,), (3,), (4,)]


def test_null_audit_equals_the_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, "c"), (3, None)], "k int, l string")
    right = spark.createDataFrame([(1, 5), (1, None), (2, 7), (None, 9)], "k int, r int")
    joined = left.join(right, "k", "left")
    expected = {c: joined.filter(F.col(c).isNull()).count() for c in joined.columns}
    assert {r["column"]: r["nulls"] for r in joins.null_audit(left, right, "k").collect()} == expected


def test_join_statements(spark):
    tracks = spark.createDataFrame([(1, "t1"), (2, "t2")], "artistID int, track string")
    tags = spark.createDataFrame([(1, "rock")], "artistID int, artist_tags string")
    assert rows(joins.JoinTags().transform(tracks, tags)) == [(1, "t1", "rock"), (2, "t2", None)]
    assert rows(joins.JoinTags(how="inner").transform(tracks, tags)) == [(1, "t1", "rock")]
    assert tuple(joins.coverage(tracks, tags).first()) == (2, 1, 0.5)
    names = spark.createDataFrame([(1, "One")], "artistID int, artist_name string")
    assert [r["artist_name"] for r in joins.lookup_name(tracks, names).orderBy("artistID").collect()] == ["One", "Unknown Artist"]


def test_listeners_and_tags(spark):
    df = spark.createDataFrame([(1, "a1"), (1, "a1"), (2, "a1"), (3, "a2")], "userID int, artistID string")
    assert rows(aggregates.ArtistListenerCounter().transform(df)) == [("a1", 2), ("a2", 1)]
    tags = spark.createDataFrame([("a1", "rock"), ("a1", "indie"), ("a1", "rock"), ("a2", "jazz"), ("a3", None)], "artistID string, tagValue string")
    assert rows(aggregates.TagAggregator("artistID").transform(tags)) == [("a1", "indie|rock"), ("a2", "jazz")]


def test_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    assert rows(aggregates.value_counts(df, "x"))[0] == ("a", 2, pytest.approx(2 / 3))
    assert aggregates.value_counts(df, "x", dropna=False).count() == 3
    assert rows(aggregates.count_of_counts(df, "x")) == [(1, 1), (2, 1)]
    assert rows(aggregates.distinct_counts(df)) == [("x", 2)]
    assert [tuple(r) for r in aggregates.null_counts(df).collect()] == [("x", 1, 0.25)]


def test_information_loss(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True), (3, False)], "userID int, hit boolean")
    assert rows(aggregates.information_loss(df, "hit")) == [(0.0, 1, 0.5), (0.5, 1, 0.5)]
    assert tuple(aggregates.match_coverage(df, "hit").first()) == (4, 2, 3, 2, 0.5)


def test_statistics_of_one_row(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0, "t")], "artistID string, tempo double, popularity double, track_name string")
    out = aggregates.artist_statistics(df, columns=["tempo"]).first()
    assert (out["tempo_mean"], out["tempo_median"], out["tempo_std"], out["num_tracks"]) == (1.0, 1.0, None, 1)


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name,score\n1,"a ""b"" c",1.5\n2,,\n')
    df = readers.StandardLoader(str(tmp_path / "t.csv"), spark, "id BIGINT, name STRING, score DOUBLE").load()
    assert rows(df) == [(1, 'a "b" c', 1.5), (2, None, None)]
    (tmp_path / "t.dat").write_bytes("id\tname\n1\tBj\xf6rk\n".encode("latin-1"))
    assert readers.StandardLoader(str(tmp_path / "t.dat"), spark).load().first()["name"] == "Björk"
    path = writers.write_parquet(df, str(tmp_path / "t.parquet"))
    assert readers.StandardLoader(path, spark).load().count() == 2
    with pytest.raises(ValueError):
        readers.StandardLoader("x.xyz", spark).load()


def test_nan_becomes_null_on_read(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(path)
    assert readers.read_parquet(spark, path).filter("x is null").count() == 1
