"""Queries for sources, cleaning, sets, joins, aggregates, ranking and scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from harmonium.functions import scalars, text
from harmonium.operators import aggregates, cleaning, joins, ranking, splits
from harmonium.plans.registry import known_id, query, r, with_views
from harmonium.session import materialise, shared_folder
from harmonium.sources import readers, views, writers
from harmonium.sources.views import V_INTERACTIONS, V_TAGS, V_TRACKS

WI, WT, WG = with_views(V_INTERACTIONS), with_views(V_TRACKS), with_views(V_TAGS)


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/harmonium/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# -- sources and sinks --------------------------------------------------------

_SUPPLIER_SQL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_SUPPLIER_SCHEMA = "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"


@query("src1_csv_read", _SUPPLIER_SQL)
def src1(spark, folder):
    path = _scratch(spark, "supplier") + ".csv"
    views.table(spark, folder, "supplier").write.option("header", True).csv(path)
    return readers.StandardLoader(path, spark, _SUPPLIER_SCHEMA).load()


@query("src2_dat_read", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def src2(spark, folder):
    path = _scratch(spark, "customer") + ".dat"
    rows = views.table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows.write.option("header", True).option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)
    return readers.StandardLoader(path, spark, "c_custkey BIGINT, c_name STRING, c_mktsegment STRING").load()


@query("src3_parquet_read", "SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def src3(spark, folder):
    lines = readers.read_parquet(spark, f"{folder}/lineitem.parquet")
    return lines.filter(F.col("l_quantity") > 45).select("l_orderkey", "l_suppkey", "l_quantity")


@query("src4_tag_text", """SELECT e.event_id, e.event_id % 30 AS "tagID", n.n_name AS "tagValue"
FROM events e LEFT JOIN nation n ON e.event_id % 30 = n.n_nationkey""")
def src4(spark, folder):
    assignments = views.table(spark, folder, "events").select("event_id", (F.col("event_id") % 30).alias("tagID"))
    tags = views.table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("tagID"), F.col("n_name").alias("tagValue"))
    return readers.load_tag_assignments(assignments, tags)


@query("snk1_parquet_write", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def snk1(spark, folder):
    rows = views.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return spark.read.parquet(writers.write_parquet(rows, _scratch(spark, "orders")))


@query("snk2_artist_names", 'SELECT s_suppkey AS "artistID", s_name AS artist_name FROM supplier')
def snk2(spark, folder):
    path = _scratch(spark, "artist-names")
    writers.export_artist_names(views.table(spark, folder, "supplier"), path, "s_suppkey", "s_name")
    return spark.read.parquet(path)


# -- projection and filters ---------------------------------------------------

_HARMONISED = {"artist_name": "string", "track_name": "string", "popularity": "double", "track_genre": "string"}


def _sources(spark, folder):
    parts = views.table(spark, folder, "part").withColumnsRenamed({"p_brand": "artists", "p_name": "track_name", "p_retailprice": "popularity", "p_type": "track_genre"})
    suppliers = views.table(spark, folder, "supplier").withColumnsRenamed({"s_name": "artist_name", "s_acctbal": "popularity"})
    customers = views.table(spark, folder, "customer").withColumnsRenamed({"c_name": "artist_name", "c_mktsegment": "genre"})
    return (
        cleaning.harmonise(parts, {"artists": "artist_name"}, _HARMONISED),
        cleaning.harmonise(suppliers, {}, _HARMONISED),
        cleaning.harmonise(customers, {"genre": "track_genre"}, _HARMONISED),
    )


_UNION_SQL = """SELECT p_brand AS artist_name, p_name AS track_name, p_retailprice AS popularity, p_type AS track_genre FROM part
UNION ALL SELECT s_name, NULL, s_acctbal, NULL FROM supplier
UNION ALL SELECT c_name, NULL, NULL, c_mktsegment FROM customer"""


@query("prj1_harmonise", """SELECT 'part' AS source, p_brand AS artist_name, p_name AS track_name, p_retailprice AS popularity, p_type AS track_genre FROM part
UNION ALL SELECT 'supplier', s_name, NULL, s_acctbal, NULL FROM supplier
UNION ALL SELECT 'customer', c_name, NULL, NULL, c_mktsegment FROM customer""")
def prj1(spark, folder):
    named = [part.withColumn("source", F.lit(name)) for name, part in zip(("part", "supplier", "customer"), _sources(spark, folder), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("prj2_rename_drop", "SELECT p_partkey AS part_id, p_name AS top_track_name, p_retailprice AS price FROM part")
def prj2(spark, folder):
    return cleaning.rename_and_drop(
        views.table(spark, folder, "part"),
        {"p_partkey": "part_id", "p_name": "top_track_name", "p_retailprice": "price"}, ["p_brand", "p_type", "p_size"])


@query("flt1_drop_missing", WT + 'SELECT track_id, "artistID", popularity FROM v_tracks WHERE popularity IS NOT NULL')
def flt1(spark, folder):
    return cleaning.drop_missing(views.tracks(spark, folder).select("track_id", "artistID", "popularity"), ["popularity"])


@query("flt2_membership", WG + """SELECT l_orderkey, l_suppkey, TRUE AS listed FROM lineitem
WHERE l_suppkey IN (SELECT "artistID" FROM v_tags WHERE "tagValue" = 'Rock')
UNION ALL SELECT l_orderkey, l_suppkey, FALSE FROM lineitem
WHERE l_suppkey NOT IN (SELECT "artistID" FROM v_tags WHERE "tagValue" = 'Rock')""")
def flt2(spark, folder):
    lines = views.table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    rock = views.tag_assignments(spark, folder).filter(F.col("tagValue") == "Rock").select("artistID").distinct()
    kept = cleaning.keep_members(lines, rock, "l_suppkey", "artistID").withColumn("listed", F.lit(True))
    left = cleaning.drop_members(lines, rock, "l_suppkey", "artistID").withColumn("listed", F.lit(False))
    return kept.unionByName(left)


@query("flt3_threshold", "SELECT event_id, value FROM events WHERE value > 60 UNION ALL SELECT event_id, value FROM events WHERE value = 0")
def flt3(spark, folder):
    events = views.table(spark, folder, "events").select("event_id", "value")
    return cleaning.above(events, "value", 60).unionByName(cleaning.equal_to(events, "value", 0))


_TRACK_COLUMNS = ("track_id", "artistID", "track_name", "popularity", "tempo", "energy", "duration_ms", "loudness", "explicit", "track_genre")


@query("flt4_null_shares", WT + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", ROUND(AVG(CASE WHEN "{c}" IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS null_share FROM v_tracks""" for c in _TRACK_COLUMNS))
def flt4_shares(spark, folder):
    return cleaning.null_shares(views.tracks(spark, folder)).withColumn("null_share", r("null_share"))


@query("flt4_drop_high_null", WT + """SELECT track_id, "artistID", popularity, tempo, energy, duration_ms, ROUND(loudness, 6) AS loudness,
track_genre, track_name FROM v_tracks""")
def flt4(spark, folder):
    return cleaning.drop_high_null_columns(views.tracks(spark, folder)).withColumn("loudness", r("loudness"))


@query("flt5_fill_missing", WT + "SELECT track_id, COALESCE(track_genre, '') AS track_genre, COALESCE(popularity, 0) AS popularity FROM v_tracks")
def flt5(spark, folder):
    return cleaning.fill_missing(views.tracks(spark, folder).select("track_id", "track_genre", "popularity"), {"track_genre": "", "popularity": 0.0})


# -- sets ---------------------------------------------------------------------

@query("set1_union_by_name", _UNION_SQL)
def set1(spark, folder):
    return cleaning.union_by_name(*_sources(spark, folder))


@query("set2_distinct", "SELECT DISTINCT p_name, p_type FROM part")
def set2(spark, folder):
    return views.table(spark, folder, "part").select("p_name", "p_type").distinct()


@query("set3_first_per_key", """SELECT p_name, p_partkey, p_retailprice FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) t WHERE rn = 1""")
def set3(spark, folder):
    parts = views.table(spark, folder, "part").select("p_name", "p_partkey", "p_retailprice")
    return ranking.first_per_key(parts, ["p_name"], [F.desc("p_retailprice"), F.asc("p_partkey")])


@query("set4_ids_of_splits", """SELECT o_custkey AS "userID" FROM orders UNION SELECT user_id FROM events UNION SELECT c_custkey FROM customer""")
def set4(spark, folder):
    parts = [
        views.table(spark, folder, "orders").select(F.col("o_custkey").alias("userID")),
        views.table(spark, folder, "events").select(F.col("user_id").alias("userID")),
        views.table(spark, folder, "customer").select(F.col("c_custkey").alias("userID")),
    ]
    return cleaning.distinct_ids(parts, "userID")


@query("set5_key_sets", """SELECT COUNT(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 END) AS matched,
COUNT(CASE WHEN b.k IS NULL THEN 1 END) AS only_left, COUNT(CASE WHEN a.k IS NULL THEN 1 END) AS only_right
FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL OUTER JOIN (SELECT DISTINCT user_id AS k FROM events) b ON a.k = b.k""")
def set5(spark, folder):
    return cleaning.key_set_counts(views.table(spark, folder, "orders"), views.table(spark, folder, "events"), "o_custkey", "user_id")


@query("set5_intersect_except", """(SELECT o_custkey AS k, 'both' AS side FROM orders INTERSECT SELECT user_id, 'both' FROM events)
UNION ALL (SELECT o_custkey, 'left' FROM orders EXCEPT SELECT user_id, 'left' FROM events)""")
def set5_keys(spark, folder):
    a = views.table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    b = views.table(spark, folder, "events").select(F.col("user_id").alias("k"))
    both = cleaning.common_keys(a, b, "k").withColumn("side", F.lit("both"))
    return both.unionByName(cleaning.missing_keys(a, b, "k").withColumn("side", F.lit("left")))


@query("set6_duplicate_rows", """SELECT CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows FROM (
SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) t""")
def set6(spark, folder):
    return cleaning.duplicate_rows(views.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


# -- joins --------------------------------------------------------------------

_TAGS_CTE = """artist_tags AS (SELECT "artistID", STRING_AGG(t, '|' ORDER BY t) AS artist_tags FROM (
  SELECT DISTINCT "artistID", "tagValue" AS t FROM v_tags WHERE "tagValue" IS NOT NULL) d GROUP BY "artistID")"""
_LISTENERS_CTE = """listeners AS (SELECT "artistID", COUNT(DISTINCT "userID") AS num_listeners FROM v_interactions GROUP BY "artistID")"""


def _tag_text(spark, folder):
    return aggregates.TagAggregator("artistID", output_col="artist_tags").transform(views.tag_assignments(spark, folder))


@query("joi1_tags", with_views(V_TRACKS, V_TAGS, _TAGS_CTE) + """SELECT t.track_id, t."artistID", a.artist_tags
FROM v_tracks t LEFT JOIN artist_tags a ON t."artistID" = a."artistID" """)
def joi1(spark, folder):
    return joins.JoinTags().transform(views.tracks(spark, folder).select("track_id", "artistID"), _tag_text(spark, folder))


@query("joi1_tags_inner", with_views(V_TRACKS, V_TAGS, _TAGS_CTE) + """SELECT t.track_id, t."artistID", a.artist_tags
FROM v_tracks t JOIN artist_tags a ON t."artistID" = a."artistID" """)
def joi1_inner(spark, folder):
    return joins.JoinTags(how="inner").transform(views.tracks(spark, folder).select("track_id", "artistID"), _tag_text(spark, folder))


@query("joi2_listeners", with_views(V_TRACKS, V_INTERACTIONS, _LISTENERS_CTE) + """SELECT t.track_id, t."artistID", l.num_listeners
FROM v_tracks t LEFT JOIN listeners l ON t."artistID" = l."artistID" """)
def joi2(spark, folder):
    listeners = aggregates.ArtistListenerCounter().transform(views.interactions(spark, folder))
    return joins.JoinArtistListeners().transform(views.tracks(spark, folder).select("track_id", "artistID"), listeners)


def _known(spark, folder):
    """Suppliers with a positive balance stand for artists with features."""
    return views.table(spark, folder, "supplier").filter(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("artistID"))


@query("joi3_known_artists", WI + """SELECT "userID", "artistID", weight FROM v_interactions
WHERE "artistID" IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def joi3(spark, folder):
    return joins.keep_known(views.interactions(spark, folder), _known(spark, folder)).select("userID", "artistID", "weight")


@query("joi3_coverage", WI + """SELECT COUNT(*) AS all_rows, COUNT(CASE WHEN k.s_suppkey IS NOT NULL THEN 1 END) AS kept_rows,
ROUND(COUNT(CASE WHEN k.s_suppkey IS NOT NULL THEN 1 END)::DOUBLE / COUNT(*), 6) AS ratio
FROM v_interactions i LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) k ON i."artistID" = k.s_suppkey""")
def joi3_coverage(spark, folder):
    return joins.coverage(views.interactions(spark, folder), _known(spark, folder)).withColumn("ratio", r("ratio"))


@query("joi4_unified_ids", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, COALESCE(m.u, -1) AS unified_artist_id FROM lineitem l
LEFT JOIN (SELECT p_partkey, p_partkey + 1000000 AS u FROM part WHERE p_size > 10) m ON l.l_partkey = m.p_partkey""")
def joi4(spark, folder):
    mapping = views.table(spark, folder, "part").filter(F.col("p_size") > 10).select("p_partkey", (F.col("p_partkey") + 1000000).alias("unified_artist_id"))
    lines = views.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.attach_unified_id(lines, mapping, "l_partkey", "p_partkey").select(*lines.columns, known_id("unified_artist_id"))


@query("joi5_artists_tracks", """SELECT s.s_suppkey AS unified_artist_id, s.s_name, l.l_orderkey FROM supplier s
LEFT JOIN lineitem l ON s.s_suppkey = l.l_suppkey""")
def joi5(spark, folder):
    artists = views.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("unified_artist_id"), "s_name")
    tracks = views.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("unified_artist_id"), "l_orderkey")
    return joins.artists_with_tracks(artists, tracks)


@query("joi6_matched_names", """SELECT p.p_partkey, p.p_name, m.n_parts FROM part p
JOIN (SELECT p_name AS match, COUNT(*) AS n_parts FROM part WHERE p_size > 25 GROUP BY p_name) m ON p.p_name = m.match""")
def joi6(spark, folder):
    parts = views.table(spark, folder, "part")
    matches = parts.filter(F.col("p_size") > 25).groupBy(F.col("p_name").alias("match")).agg(F.count("*").alias("n_parts"))
    return joins.tracks_of_matches(parts.select("p_partkey", "p_name"), matches, "p_name", "match").drop("match")


@query("joi7_group_statistics", WT + """SELECT t.track_id, t."artistID", s.max_popularity FROM v_tracks t
LEFT JOIN (SELECT "artistID", MAX(popularity) AS max_popularity FROM v_tracks GROUP BY "artistID") s ON t."artistID" = s."artistID" """)
def joi7(spark, folder):
    tracks = views.tracks(spark, folder).select("track_id", "artistID", "popularity")
    stats = tracks.groupBy("artistID").agg(F.max("popularity").alias("max_popularity"))
    return joins.with_group_statistics(tracks.drop("popularity"), stats, "artistID")


@query("joi9_null_audit", """WITH j AS (SELECT e.user_id, e.event_type, o.o_orderkey, o.o_totalprice
FROM events e LEFT JOIN orders o ON e.user_id = o.o_custkey)
SELECT 'user_id' AS "column", COUNT(*) - COUNT(user_id) AS nulls FROM j
UNION ALL SELECT 'event_type', COUNT(*) - COUNT(event_type) FROM j
UNION ALL SELECT 'o_orderkey', COUNT(*) - COUNT(o_orderkey) FROM j
UNION ALL SELECT 'o_totalprice', COUNT(*) - COUNT(o_totalprice) FROM j""")
def joi9(spark, folder):
    users = views.table(spark, folder, "events").select("user_id", "event_type")
    stamps = views.table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_totalprice")
    return joins.null_audit(users, stamps, "user_id")


@query("joi10_name_lookup", """SELECT e.event_id, e.event_id % 300 AS "artistID", COALESCE(s.s_name, 'Unknown Artist') AS artist_name
FROM events e LEFT JOIN supplier s ON e.event_id % 300 = s.s_suppkey""")
def joi10(spark, folder):
    ids = views.table(spark, folder, "events").select("event_id", (F.col("event_id") % 300).alias("artistID"))
    names = writers.artist_names(views.table(spark, folder, "supplier"), "s_suppkey", "s_name")
    return joins.lookup_name(ids, names)


# -- aggregates ---------------------------------------------------------------

@query("agg1_listeners", with_views(V_INTERACTIONS, _LISTENERS_CTE) + "SELECT * FROM listeners")
def agg1(spark, folder):
    return aggregates.ArtistListenerCounter().transform(views.interactions(spark, folder))


@query("agg2_artist_tags", with_views(V_TAGS, _TAGS_CTE) + "SELECT * FROM artist_tags")
def agg2(spark, folder):
    return _tag_text(spark, folder)


@query("agg2_user_tags", WG + """SELECT "userID", STRING_AGG(t, '|' ORDER BY t) AS aggregated_tags FROM (
SELECT DISTINCT "userID", "tagValue" AS t FROM v_tags WHERE "tagValue" IS NOT NULL) d GROUP BY "userID" """)
def agg2_user(spark, folder):
    return aggregates.TagAggregator("userID").transform(views.tag_assignments(spark, folder))


_STAT_COLUMNS = ("tempo", "energy", "popularity")


@query("agg3_artist_statistics", WT + 'SELECT "artistID", ' + ", ".join(
    f"ROUND(AVG({c}), 6) AS {c}_mean, ROUND(CAST(MEDIAN({c}) AS DOUBLE), 6) AS {c}_median, MIN({c}) AS {c}_min, MAX({c}) AS {c}_max, ROUND(STDDEV_SAMP({c}), 6) AS {c}_std"
    for c in _STAT_COLUMNS) + ', COUNT(track_name) AS num_tracks FROM v_tracks GROUP BY "artistID"')
def agg3(spark, folder):
    stats = aggregates.artist_statistics(views.tracks(spark, folder), columns=("tempo", "energy"))
    return stats.withColumns({f"{c}_{s}": r(f"{c}_{s}") for c in _STAT_COLUMNS for s in ("mean", "median", "std")})


@query("agg4_max_popularity", WT + 'SELECT "artistID", MAX(popularity) AS popularity FROM v_tracks GROUP BY "artistID"')
def agg4(spark, folder):
    return aggregates.artist_popularity(views.tracks(spark, folder))


@query("agg7_user_ranges", WI + 'SELECT "userID", MIN(weight) AS min_weight, MAX(weight) AS max_weight FROM v_interactions GROUP BY "userID"')
def agg7(spark, folder):
    return aggregates.user_ranges(views.interactions(spark, folder))


@query("agg8_null_counts", WT + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(*) - COUNT("{c}") AS nulls, ROUND((COUNT(*) - COUNT("{c}"))::DOUBLE / COUNT(*), 6) AS share FROM v_tracks""" for c in _TRACK_COLUMNS))
def agg8(spark, folder):
    return aggregates.null_counts(views.tracks(spark, folder)).withColumn("share", r("share"))


@query("agg9_value_counts", WG + """SELECT "tagValue" AS value, COUNT(*) AS n, ROUND(COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM v_tags), 6) AS share
FROM v_tags GROUP BY "tagValue" """)
def agg9(spark, folder):
    return aggregates.value_counts(views.tag_assignments(spark, folder), "tagValue", dropna=False).withColumn("share", r("share"))


@query("agg10_count_of_counts", "SELECT n, COUNT(*) AS keys FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) t GROUP BY n")
def agg10(spark, folder):
    return aggregates.count_of_counts(views.table(spark, folder, "events"), "user_id")


@query("agg11_distinct_counts", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS distinct_values FROM lineitem"""
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")))
def agg11(spark, folder):
    return aggregates.distinct_counts(views.table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"])


@query("agg12_quantiles", "\nUNION ALL ".join(
    f"SELECT 'q{int(p * 100)}' AS stat, ROUND(QUANTILE_CONT(l_extendedprice, {p}), 4) AS value FROM lineitem" for p in (0.25, 0.5, 0.75))
    + "\nUNION ALL SELECT 'mean', ROUND(AVG(l_extendedprice), 4) FROM lineitem")
def agg12(spark, folder):
    return aggregates.quantile_report(views.table(spark, folder, "lineitem"), "l_extendedprice").withColumn("value", r("value", 4))


@query("agg13_match_coverage", """WITH u AS (SELECT user_id, COUNT(*) AS n, COUNT(CASE WHEN value > 60 THEN 1 END) AS kept FROM events GROUP BY user_id)
SELECT CAST(SUM(n) AS BIGINT) AS all_rows, CAST(SUM(n - kept) AS BIGINT) AS unmatched_rows, COUNT(user_id) AS users,
COUNT(CASE WHEN kept > 0 THEN 1 END) AS surviving_users, ROUND(SUM(n - kept)::DOUBLE / SUM(n)::DOUBLE, 6) AS unmatched_share FROM u""")
def agg13(spark, folder):
    rows = views.table(spark, folder, "events").withColumn("hit", F.col("value") > 60)
    return aggregates.match_coverage(rows, "hit", "user_id").withColumn("unmatched_share", r("unmatched_share"))


@query("agg13_information_loss", """WITH u AS (SELECT user_id, COUNT(*) AS n, COUNT(CASE WHEN value > 60 THEN 1 END) AS kept FROM events GROUP BY user_id),
l AS (SELECT (n - kept)::DOUBLE / n AS lost FROM u WHERE kept > 0)
SELECT ROUND(lost, 9) AS lost_fraction, COUNT(*) AS users, ROUND(COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM l), 6) AS share FROM l GROUP BY lost""")
def agg13_loss(spark, folder):
    rows = views.table(spark, folder, "events").withColumn("hit", F.col("value") > 60)
    return aggregates.information_loss(rows, "hit", "user_id").withColumns({"lost_fraction": r("lost_fraction", 9), "share": r("share")})


@query("agg14_pair_sums", 'SELECT o_custkey AS "userID", l_suppkey AS "artistID", SUM(l_quantity) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2')
def agg14(spark, folder):
    orders = views.table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("userID"))
    lines = views.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("artistID"), F.col("l_quantity").alias("weight"))
    return aggregates.pair_sums(orders.join(lines, "k"))


# -- ranking and splits -------------------------------------------------------

@query("win1_most_popular_track", WT + """SELECT track_id, "artistID", popularity, tempo FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY "artistID" ORDER BY popularity DESC NULLS LAST, track_id) AS rn,
MAX(popularity) OVER (PARTITION BY "artistID") AS best FROM v_tracks) t WHERE rn = 1 OR best IS NULL""")
def win1(spark, folder):
    return ranking.most_popular_track(views.tracks(spark, folder).select("track_id", "artistID", "popularity", "tempo"))


@query("win2_first_after_sort", WT + """SELECT "artistID", track_id, popularity FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY "artistID" ORDER BY popularity DESC NULLS LAST, track_id) AS rn FROM v_tracks) t WHERE rn = 1""")
def win2(spark, folder):
    tracks = views.tracks(spark, folder).select("artistID", "track_id", "popularity")
    return ranking.first_per_key(tracks, ["artistID"], [F.desc_nulls_last("popularity"), F.asc("track_id")])


@query("win3_dense_index", """SELECT o_custkey AS "userID", ROW_NUMBER() OVER (ORDER BY MD5(CAST(o_custkey AS VARCHAR) || '|'), o_custkey) - 1 AS user_idx
FROM (SELECT DISTINCT o_custkey FROM orders) t""")
def win3(spark, folder):
    return ranking.dense_index(views.table(spark, folder, "orders").select(F.col("o_custkey").alias("userID")), "userID", "user_idx")


@query("win3_index_lookup", """WITH idx AS (SELECT o_custkey AS "userID", ROW_NUMBER() OVER (ORDER BY MD5(CAST(o_custkey AS VARCHAR) || '|'), o_custkey) - 1 AS user_idx
FROM (SELECT DISTINCT o_custkey FROM orders) t)
SELECT c.c_custkey AS "userID", COALESCE(i.user_idx, -1) AS user_idx FROM customer c LEFT JOIN idx i ON c.c_custkey = i."userID" """)
def win3_lookup(spark, folder):
    index = ranking.dense_index(views.table(spark, folder, "orders").select(F.col("o_custkey").alias("userID")), "userID", "user_idx")
    return ranking.lookup_index(views.table(spark, folder, "customer").select(F.col("c_custkey").alias("userID")), index, "userID", "user_idx")


def split_sql(per_user: bool, test: float, val: float, seed: int, view: str = V_INTERACTIONS) -> str:
    """CTEs ending in v_split: v_interactions with its part."""
    over = 'PARTITION BY "userID" ' if per_user else ""
    keep = "n >= 3" if per_user else "TRUE"
    ratio = val / (1 - test)
    return with_views(view, f"""ranked AS (SELECT "userID", "artistID", weight,
    ROW_NUMBER() OVER ({over}ORDER BY MD5(CAST("userID" AS VARCHAR) || '|' || CAST("artistID" AS VARCHAR) || '|{seed}'), "userID", "artistID") - 1 AS pos,
    COUNT(*) OVER ({over}) AS n FROM v_interactions)""", f"""sized AS (SELECT *, CASE WHEN {keep} THEN CAST(CEIL(n * CAST({test!r} AS DOUBLE)) AS BIGINT) ELSE 0 END AS t FROM ranked)""",
    f"""parts AS (SELECT *, CASE WHEN t = 0 OR CEIL((n - t) * CAST({ratio!r} AS DOUBLE)) >= n - t THEN 0
    ELSE CAST(CEIL((n - t) * CAST({ratio!r} AS DOUBLE)) AS BIGINT) END AS v FROM sized)""",
    """v_split AS (SELECT "userID", "artistID", weight, CASE WHEN pos < t THEN 'test' WHEN pos < t + v THEN 'val' ELSE 'train' END AS split FROM parts)""")


@query("win4_random_split", split_sql(False, 0.2, 0.1, 42) + "SELECT * FROM v_split")
def win4(spark, folder):
    return splits.random_split(views.interactions(spark, folder))


@query("win5_user_split", split_sql(True, 0.15, 0.15, 42) + "SELECT * FROM v_split")
def win5(spark, folder):
    return splits.user_stratified_split(views.interactions(spark, folder), 0.15, 0.15, 42)


@query("win6_split_sizes", split_sql(True, 0.2, 0.1, 42) + "SELECT split, COUNT(*) AS n FROM v_split GROUP BY split")
def win6(spark, folder):
    loader = readers.StandardLoader(spark=spark)
    train, test, val = loader.train_test_val_split(views.interactions(spark, folder), strategy="user_stratified")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("split"), "n") for name, df in (("train", train), ("test", test), ("val", val))]
    return cleaning.union_by_name(*parts)


@query("win7_top_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10")
def win7(spark, folder):
    lines = views.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return ranking.top_rows(lines, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 10)


# -- scalar functions ---------------------------------------------------------

@query("sca1_pipe_concat", "SELECT p_partkey, TRIM(COALESCE(NULLIF(p_type, 'SMALL'), '') || '|' || COALESCE(NULLIF(p_name, 'red widget'), ''), '|') AS joined FROM part")
def sca1(spark, folder):
    return views.table(spark, folder, "part").select(
        "p_partkey", text.pipe_concat(F.nullif("p_type", F.lit("SMALL")), F.nullif("p_name", F.lit("red widget"))).alias("joined"))


def flag_sql(column: str) -> str:
    """The flag columns of a text column as SQL."""
    out = []
    for group, families in text.FLAG_GROUPS.items():
        for family, words in families.items():
            hit = " OR ".join(f"LOWER({column}) LIKE '%{w}%'" for w in words)
            out.append(f"CASE WHEN {hit} THEN 1 ELSE 0 END AS {group}_{family}")
    return ", ".join(out)


@query("sca2_keyword_flags", f"SELECT doc_id, {flag_sql('text')} FROM documents")
def sca2(spark, folder):
    docs = views.table(spark, folder, "documents")
    return docs.select("doc_id", *[c.alias(n) for n, c in text.keyword_flags("text").items()])


@query("sca3_epoch_ms", "SELECT event_id, MAKE_TIMESTAMP((event_id * 86399123 + 1104537600000) * 1000) AS at FROM events")
def sca3(spark, folder):
    ms = F.col("event_id") * 86399123 + 1104537600000
    return views.table(spark, folder, "events").select("event_id", scalars.from_epoch_ms(ms).alias("at"))


@query("sca4_date_parts", """SELECT event_id, CAST(HOUR(ts) AS INTEGER) AS hour, CAST(DAY(ts) AS INTEGER) AS day,
CAST(ISODOW(ts) - 1 AS INTEGER) AS weekday, CAST(MONTH(ts) AS INTEGER) AS month FROM events""")
def sca4(spark, folder):
    return views.table(spark, folder, "events").select("event_id", *[c.alias(n) for n, c in scalars.date_parts("ts").items()])


@query("sca5_offset_log", "SELECT event_id, ROUND(LN(value + 1e-10), 6) AS log_value FROM events WHERE value > 0")
def sca5(spark, folder):
    events = views.table(spark, folder, "events").filter(F.col("value") > 0)
    return events.select("event_id", r(scalars.offset_log("value")).alias("log_value"))


@query("sca6_min_max", """SELECT p_partkey, ROUND(CASE WHEN hi > lo THEN (p_size - lo) / (hi - lo)::DOUBLE ELSE 0.5 END, 6) AS scaled FROM (
SELECT p_partkey, p_size, MIN(p_size) OVER (PARTITION BY p_name, p_type) AS lo, MAX(p_size) OVER (PARTITION BY p_name, p_type) AS hi FROM part) t""")
def sca6(spark, folder):
    parts = views.table(spark, folder, "part")
    ranges = parts.groupBy("p_name", "p_type").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    joined = parts.join(ranges, ["p_name", "p_type"])
    return joined.select("p_partkey", r(scalars.min_max(F.col("p_size").cast("double"), F.col("lo"), F.col("hi"), 0.5)).alias("scaled"))


@query("sca7_safe_user_id", "SELECT page_id, REGEXP_REPLACE(url, '[^\\p{L}\\p{N}_-]', '', 'g') AS safe_id FROM pages")
def sca7(spark, folder):
    return views.table(spark, folder, "pages").select("page_id", text.safe_user_id("url").alias("safe_id"))


@query("sca8_rank_weight", "SELECT p_partkey, ROUND(CASE WHEN p_size BETWEEN 1 AND 10 THEN (11 - p_size) / 10.0::DOUBLE ELSE 0.5 END, 6) AS weight FROM part")
def sca8(spark, folder):
    return views.table(spark, folder, "part").select("p_partkey", r(scalars.rank_weight("p_size")).alias("weight"))


@query("sca9_abs_log2", "SELECT c_custkey, ABS(c_acctbal) AS abs_balance, ROUND(1.0 / LOG2(c_custkey + 2.0), 6) AS discount FROM customer")
def sca9(spark, folder):
    return views.table(spark, folder, "customer").select(
        "c_custkey", F.abs("c_acctbal").alias("abs_balance"), r(scalars.log2_discount(F.col("c_custkey") + 1)).alias("discount"))
