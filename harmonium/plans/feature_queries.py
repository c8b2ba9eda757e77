"""Queries for the feature stages and composed flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from harmonium.functions.text import FLAG_GROUPS
from harmonium.operators import features, splits
from harmonium.operators.aggregates import ArtistListenerCounter
from harmonium.operators.interactions import ArtistFeaturesBuilder, InteractionMatrixBuilder
from harmonium.operators.joins import JoinArtistListeners
from harmonium.plans.preprocessing import ArtistMetadataPipeline, GeneralPreprocessingPipeline
from harmonium.plans.registry import query, r, with_views
from harmonium.plans.relational_queries import _LISTENERS_CTE, _TAGS_CTE, flag_sql, split_sql
from harmonium.sources import views
from harmonium.sources.views import V_INTERACTIONS, V_TAGS, V_TRACKS

FLAGS = [f"{g}_{f}" for g, families in FLAG_GROUPS.items() for f in families]
NUMERIC = ["tempo", "energy", "duration_ms", "loudness", "num_listeners"]

V_ENRICHED = f"""{V_TRACKS}, {V_TAGS}, {V_INTERACTIONS}, {_TAGS_CTE}, {_LISTENERS_CTE}, v_enriched AS (
  SELECT t.*, a.artist_tags, l.num_listeners FROM v_tracks t
  LEFT JOIN artist_tags a ON t."artistID" = a."artistID" LEFT JOIN listeners l ON t."artistID" = l."artistID")"""

_IMPUTED = """imputed AS (SELECT e.* EXCLUDE (popularity, explicit), COALESCE(popularity,
  (num_listeners - lo) / CASE WHEN hi > lo THEN (hi - lo)::DOUBLE ELSE 1.0 END * 100.0) AS popularity
  FROM v_enriched e, (SELECT MIN(num_listeners) AS lo, MAX(num_listeners) AS hi FROM v_enriched WHERE popularity IS NOT NULL) s)"""

_FLAGGED = f"""texted AS (SELECT *, TRIM(COALESCE(track_genre, '') || '|' || COALESCE(artist_tags, ''), '|') AS tag_genre_text FROM imputed),
flagged AS (SELECT *, {flag_sql('tag_genre_text')} FROM texted)"""

_SELECTED = """selected AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "artistID" ORDER BY popularity DESC NULLS LAST, track_id) AS rn,
  MAX(popularity) OVER (PARTITION BY "artistID") AS best FROM flagged) t WHERE rn = 1 OR best IS NULL)"""


def _features_cte(source: str, name: str = "feats") -> str:
    means = ", ".join(f"COALESCE(AVG({c}), (SELECT AVG({c}) FROM {source})) AS {c}" for c in NUMERIC)
    modes = ", ".join(f"CASE WHEN SUM({c}) * 2 > COUNT({c}) THEN 1 ELSE 0 END AS {c}" for c in FLAGS)
    return f'{name} AS (SELECT "artistID", {means}, {modes} FROM {source} GROUP BY "artistID")'


def _scaled_select(source: str) -> str:
    cells = []
    for c in NUMERIC:
        cells.append(
            f"ROUND(CASE WHEN d_{c} <= 2 THEN {c} WHEN lo_{c} <= 0 THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) "
            f"ELSE (LN({c} + 1e-10) - LN(lo_{c} + 1e-10)) / (LN(hi_{c} + 1e-10) - LN(lo_{c} + 1e-10)) END, 6) AS {c}")
    stats = ", ".join(f"COUNT(DISTINCT {c}) AS d_{c}, MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}" for c in NUMERIC)
    return f'SELECT "artistID", {", ".join(cells)}, {", ".join(FLAGS)} FROM {source}, (SELECT {stats} FROM {source}) s'


def enriched(spark, folder):
    flow = GeneralPreprocessingPipeline()
    return flow.run(views.interactions(spark, folder), views.tag_assignments(spark, folder), views.tracks(spark, folder))["spotify"]


def split_interactions(spark, folder):
    """The user-stratified split, written once for all its readers."""
    return splits.user_stratified_split(views.interactions(spark, folder), 0.15, 0.15, 42)


def artist_features(spark, folder):
    """One scaled feature row per artist."""
    return ArtistMetadataPipeline(NUMERIC, popularity_path="").fit_transform(enriched(spark, folder))


_WITH_ENRICHED = with_views(V_ENRICHED)
_WITH_SELECTED = with_views(V_ENRICHED, _IMPUTED, _FLAGGED, _SELECTED)


@query("fea1_popularity_imputer", with_views(V_ENRICHED, _IMPUTED) + "SELECT track_id, num_listeners, ROUND(popularity, 6) AS popularity FROM imputed")
def fea1(spark, folder):
    listeners = ArtistListenerCounter().transform(views.interactions(spark, folder))
    tracks = JoinArtistListeners().transform(views.tracks(spark, folder), listeners).select("track_id", "num_listeners", "popularity")
    return features.PopularityImputer().fit_transform(tracks).withColumn("popularity", r("popularity"))


@query("fea2_genre_tags", _WITH_ENRICHED + """SELECT track_id, COALESCE(track_genre, '') AS track_genre, COALESCE(artist_tags, '') AS artist_tags,
TRIM(COALESCE(track_genre, '') || '|' || COALESCE(artist_tags, ''), '|') AS tag_genre_text FROM v_enriched""")
def fea2(spark, folder):
    return features.GenreTagCombiner().transform(enriched(spark, folder).select("track_id", "track_genre", "artist_tags"))


@query("fea3_keyword_flags", with_views(V_ENRICHED, _IMPUTED, _FLAGGED) + f"SELECT track_id, {', '.join(FLAGS)} FROM flagged")
def fea3(spark, folder):
    texted = features.GenreTagCombiner().transform(enriched(spark, folder).select("track_id", "track_genre", "artist_tags"))
    return features.HighLevelGenreFeatureGenerator().transform(texted).select("track_id", *FLAGS)


@query("fea4_artist_features", with_views(V_ENRICHED, _IMPUTED, _FLAGGED, _features_cte("flagged")) +
       f'SELECT "artistID", {", ".join(f"ROUND({c}, {4 if c == 'duration_ms' else 8}) AS {c}" for c in NUMERIC)}, {", ".join(FLAGS)} FROM feats')
def fea4(spark, folder):
    texted = features.GenreTagCombiner().transform(enriched(spark, folder))
    flagged = features.HighLevelGenreFeatureGenerator().transform(texted)
    built = features.ArtistNumericFeatureBuilder(numeric_cols=NUMERIC).transform(flagged)
    return built.withColumns({c: r(c, 4 if c == "duration_ms" else 8) for c in NUMERIC})


@query("agg5_mean_with_fallback", with_views(V_TRACKS) + """SELECT "artistID", ROUND(COALESCE(AVG(popularity), (SELECT AVG(popularity) FROM v_tracks)), 6) AS popularity,
ROUND(COALESCE(AVG(duration_ms), (SELECT AVG(duration_ms) FROM v_tracks)), 4) AS duration_ms FROM v_tracks GROUP BY "artistID" """)
def agg5(spark, folder):
    built = features.ArtistNumericFeatureBuilder(numeric_cols=["popularity", "duration_ms"]).transform(views.tracks(spark, folder))
    return built.withColumns({"popularity": r("popularity"), "duration_ms": r("duration_ms", 4)})


@query("agg6_flag_modes", with_views(V_ENRICHED, _IMPUTED, _FLAGGED) + 'SELECT "artistID", ' + ", ".join(
    f"CASE WHEN SUM({c}) * 2 > COUNT({c}) THEN 1 ELSE 0 END AS {c}" for c in FLAGS) + ' FROM flagged GROUP BY "artistID"')
def agg6(spark, folder):
    texted = features.GenreTagCombiner().transform(enriched(spark, folder).select("artistID", "track_genre", "artist_tags"))
    flagged = features.HighLevelGenreFeatureGenerator().transform(texted)
    return features.ArtistNumericFeatureBuilder(numeric_cols=[]).transform(flagged)


def _track_numbers(spark, folder):
    return views.tracks(spark, folder).select("track_id", "artistID", "tempo", "energy", "duration_ms", "loudness")


@query("fea5_log_minmax", with_views(V_TRACKS) + """SELECT track_id, "artistID",
ROUND((LN(tempo + 1e-10) - LN(lo1 + 1e-10)) / (LN(hi1 + 1e-10) - LN(lo1 + 1e-10)), 6) AS tempo,
ROUND((energy - lo2) / (hi2 - lo2), 6) AS energy,
ROUND((LN(duration_ms + 1e-10) - LN(lo3 + 1e-10)) / (LN(hi3 + 1e-10) - LN(lo3 + 1e-10)), 6) AS duration_ms,
ROUND((loudness - lo4) / (hi4 - lo4), 6) AS loudness
FROM v_tracks, (SELECT MIN(tempo) AS lo1, MAX(tempo) AS hi1, MIN(energy) AS lo2, MAX(energy) AS hi2, MIN(duration_ms) AS lo3,
MAX(duration_ms) AS hi3, MIN(loudness) AS lo4, MAX(loudness) AS hi4 FROM v_tracks) s""")
def fea5(spark, folder):
    scaled = features.LogMinMaxScaler().fit_transform(_track_numbers(spark, folder))
    return scaled.withColumns({c: r(c) for c in ("tempo", "energy", "duration_ms", "loudness")})


@query("fea6_scaler_report", with_views(V_TRACKS) + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature, CASE WHEN COUNT(DISTINCT {c}) <= 2 THEN 'binary' WHEN MIN({c}) <= 0 THEN 'minmax' ELSE 'log_minmax' END AS treatment,
    ROUND(CASE WHEN MIN({c}) <= 0 THEN MIN({c}) ELSE LN(MIN({c}) + 1e-10) END, 6) AS low,
    ROUND(CASE WHEN MIN({c}) <= 0 THEN MAX({c}) ELSE LN(MAX({c}) + 1e-10) END, 6) AS high FROM v_tracks""" for c in ("tempo", "energy", "duration_ms", "loudness")))
def fea6(spark, folder):
    tracks = _track_numbers(spark, folder)
    report = features.LogMinMaxScaler().fit(tracks).report(tracks)
    return report.withColumns({"low": r("low"), "high": r("high")})


@query("fea7_user_scaling", split_sql(True, 0.15, 0.15, 42) + """SELECT s.split, s."userID", s."artistID", ROUND(CASE WHEN hi > lo THEN (weight - lo) / (hi - lo) ELSE 1.0 END, 6) AS weight
FROM v_split s JOIN (SELECT "userID", MIN(weight) AS lo, MAX(weight) AS hi FROM v_split WHERE split = 'train' GROUP BY "userID") r ON s."userID" = r."userID" """)
def fea7(spark, folder):
    parts = split_interactions(spark, folder)
    scaler = features.UserMinMaxListeningScaler().fit(splits.in_part(parts, "train"))
    scaled = [scaler.transform(splits.in_part(parts, p)).withColumn("split", F.lit(p)) for p in ("train", "val", "test")]
    rows = scaled[0].unionByName(scaled[1]).unionByName(scaled[2])
    return rows.withColumn("weight", r("weight"))


@query("joi8_user_ranges", with_views(V_INTERACTIONS) + """SELECT i."userID", i."artistID", ROUND(CASE WHEN lo IS NULL THEN NULL WHEN hi > lo THEN (weight - lo) / (hi - lo) ELSE 1.0 END, 6) AS weight
FROM v_interactions i LEFT JOIN (SELECT "userID", MIN(weight) AS lo, MAX(weight) AS hi FROM v_interactions JOIN customer ON "userID" = c_custkey WHERE c_acctbal > 0 GROUP BY "userID") r ON i."userID" = r."userID" """)
def joi8(spark, folder):
    """Users without a positive balance are unseen in the fit and get null."""
    rows = views.interactions(spark, folder)
    solvent = views.table(spark, folder, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("userID"))
    scaler = features.UserMinMaxListeningScaler(on_unseen="null").fit(rows.join(solvent, "userID", "left_semi"))
    return scaler.transform(rows).withColumn("weight", r("weight"))


@query("fea8_enriched_tracks", _WITH_ENRICHED + 'SELECT track_id, "artistID", popularity, track_genre, artist_tags, num_listeners FROM v_enriched')
def fea8(spark, folder):
    return enriched(spark, folder).select("track_id", "artistID", "popularity", "track_genre", "artist_tags", "num_listeners")


@query("fea9_artist_metadata", with_views(V_ENRICHED, _IMPUTED, _FLAGGED, _SELECTED, _features_cte("selected")) + _scaled_select("feats"))
def fea9(spark, folder):
    return artist_features(spark, folder).withColumns({c: r(c) for c in NUMERIC})


def _index_cte(name: str, column: str, out: str) -> str:
    return f"""{name} AS (SELECT k AS "{column}", ROW_NUMBER() OVER (ORDER BY MD5(CAST(k AS VARCHAR) || '|'), k) - 1 AS {out}
  FROM (SELECT DISTINCT "{column}" AS k FROM v_interactions) t)"""


def _builder(spark, folder):
    parts = split_interactions(spark, folder)
    return InteractionMatrixBuilder().fit(*[splits.in_part(parts, p) for p in ("train", "test", "val")])


@query("fea10_interaction_table", with_views(V_INTERACTIONS, _index_cte("um", "userID", "user_idx"), _index_cte("am", "artistID", "artist_idx")) + """SELECT user_idx, artist_idx, weight
FROM v_interactions i JOIN um ON i."userID" = um."userID" JOIN am ON i."artistID" = am."artistID" """)
def fea10(spark, folder):
    return _builder(spark, folder).transform(views.interactions(spark, folder))


def _plain_features(spark, folder):
    """Unscaled artist features with zeros: discounts and quantities of suppliers with a positive balance."""
    rich = views.table(spark, folder, "supplier").filter(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("artistID"))
    lines = views.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("artistID")).agg(
        F.min("l_discount").alias("min_discount"), F.max("l_quantity").alias("max_quantity"), F.min("l_tax").alias("min_tax"))
    return lines.join(rich, "artistID", "left_semi")


_PLAIN_CTE = """plain AS (SELECT l_suppkey AS "artistID", MIN(l_discount) AS min_discount, MAX(l_quantity) AS max_quantity, MIN(l_tax) AS min_tax
  FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey)"""


@query("fea11_sparse_features", with_views(V_INTERACTIONS, _index_cte("am", "artistID", "artist_idx"), _PLAIN_CTE, """cells AS (
  SELECT "artistID", 'min_discount' AS feature, min_discount AS value FROM plain UNION ALL SELECT "artistID", 'max_quantity', max_quantity FROM plain
  UNION ALL SELECT "artistID", 'min_tax', min_tax FROM plain)""") + """SELECT am."artistID", am.artist_idx, c.feature, c.value FROM am
LEFT JOIN (SELECT * FROM cells WHERE value <> 0) c ON am."artistID" = c."artistID" """)
def fea11(spark, folder):
    return ArtistFeaturesBuilder().fit_transform(_plain_features(spark, folder), _builder(spark, folder).artist_map)


@query("fea12_feature_vectors", with_views(_PLAIN_CTE) + """SELECT s.s_suppkey AS "artistID", COALESCE(min_discount, 0) AS f0, COALESCE(max_quantity, 0) AS f1, COALESCE(min_tax, 0) AS f2
FROM supplier s LEFT JOIN plain p ON s.s_suppkey = p."artistID" """)
def fea12(spark, folder):
    ids = views.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("artistID"))
    dense = ArtistFeaturesBuilder().dense(_plain_features(spark, folder), ids)
    return dense.select("artistID", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(3)])


@query("fea13_new_user_preferences", with_views(V_INTERACTIONS, _index_cte("am", "artistID", "artist_idx")) + """SELECT e.user_id AS "userID", e.a AS "artistID", am.artist_idx, ROUND(e.value, 6) AS weight FROM (
SELECT user_id, event_id % 150 AS a, value, ROW_NUMBER() OVER (PARTITION BY user_id, event_id % 150 ORDER BY event_id DESC) AS rn FROM events) e
JOIN am ON e.a = am."artistID" WHERE rn = 1""")
def fea13(spark, folder):
    surveys = views.table(spark, folder, "events").select(
        F.col("user_id").alias("userID"), (F.col("event_id") % 150).alias("artistID"), F.col("value").alias("weight"), "event_id")
    return _builder(spark, folder).new_user_preferences(surveys, order_col="event_id").withColumn("weight", r("weight"))
