"""Queries for name matching and unified ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from harmonium.functions import text
from harmonium.functions.similarity import indel_similarity
from harmonium.operators import matching
from harmonium.operators.idmap import ArtistIDMapper
from harmonium.plans.registry import known_id, query, r, with_views
from harmonium.plans.unified_mapping import generate_unified_artist_mappings
from harmonium.sources import views
from harmonium.sources.views import V_NAMES_LEFT, V_NAMES_RIGHT

_SIMPLE = "TRIM(REGEXP_REPLACE(LOWER({c}), '\\s+', ' ', 'g'))"
_PLAIN = "REPLACE(REPLACE(REPLACE(STRIP_ACCENTS({c}), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"
_FULL = "TRIM(REGEXP_REPLACE(REGEXP_REPLACE(" + _PLAIN.format(c="LOWER({c})") + ", '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_CLEAN = "LOWER(" + _PLAIN.format(c="REGEXP_REPLACE(REGEXP_REPLACE(TRIM(LOWER({c})), '[()\\[\\]{{}}]+', '', 'g'), '\\s+', ' ', 'g')") + ")"


def simple_sql(c: str) -> str:
    return _SIMPLE.format(c=c)


def full_sql(c: str) -> str:
    return _FULL.format(c=c)


def blocks_sql(c: str, size: int = 3) -> str:
    return (f"CASE WHEN LENGTH({c}) < {size} THEN [{c}] ELSE LIST_DISTINCT([SUBSTRING({c}, 1, {size}), RIGHT({c}, {size})] || "
            f"CASE WHEN LENGTH({c}) >= {2 * size} THEN [SUBSTRING({c}, CAST(FLOOR(LENGTH({c}) / 2) AS BIGINT) + 1, {size})] ELSE [] END) END")


def lcs_sql(a: str, b: str) -> str:
    """Bit-parallel LCS length of two strings of at most 60 characters."""
    full = f"((1::BIGINT << LENGTH({a})) - 1)"
    hits = f"COALESCE(LIST_SUM(LIST_TRANSFORM(RANGE(1, LENGTH({a}) + 1), lambda i: CASE WHEN SUBSTRING({a}, i, 1) = ch THEN 1::BIGINT << (i - 1) ELSE 0 END)), 0)::BIGINT"
    steps = f"LIST_TRANSFORM(STRING_SPLIT({b}, ''), lambda ch: {hits})"
    state = f"LIST_REDUCE({steps}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"(LENGTH({a}) - BIT_COUNT({state}))"


V_MATCH = with_views(V_NAMES_RIGHT, V_NAMES_LEFT, f"""rn AS (SELECT name, "artistID", {simple_sql('name')} AS simple, {full_sql('name')} AS norm FROM v_names_right)""",
    """rs AS (SELECT simple, MIN(name) AS name FROM rn GROUP BY simple)""", """rf AS (SELECT norm, MIN(name) AS name FROM rn GROUP BY norm)""",
    f"""ln AS (SELECT artist_name, {simple_sql('artist_name')} AS simple, {full_sql('artist_name')} AS norm FROM v_names_left)""",
    "exact AS (SELECT ln.artist_name, rs.name, 100 AS score, 0 AS phase FROM ln JOIN rs ON ln.simple = rs.simple)",
    "queries AS (SELECT DISTINCT norm FROM ln WHERE simple NOT IN (SELECT simple FROM rs))",
    f"qb AS (SELECT norm, {blocks_sql('norm')} AS b FROM queries)", f"rb AS (SELECT norm, {blocks_sql('norm')} AS b FROM rf)",
    """hit AS (SELECT DISTINCT q.norm FROM (SELECT norm, UNNEST(b) AS k FROM qb WHERE LENGTH(norm) >= 3) q JOIN (SELECT UNNEST(b) AS k FROM rb) c ON q.k = c.k)""",
    """pairs AS (SELECT q.norm AS q, c.norm AS c FROM qb q, rb c WHERE q.norm NOT IN (SELECT norm FROM hit) OR LIST_HAS_ANY(q.b, c.b))""",
    f"""sims AS (SELECT q, c, 1.0::DOUBLE - (LENGTH(q) + LENGTH(c) - 2 * {lcs_sql('q', 'c')}) / (LENGTH(q) + LENGTH(c))::DOUBLE AS sim FROM pairs)""",
    "best AS (SELECT q, c, sim FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY sim DESC, c) AS n FROM sims WHERE sim >= 0.85) t WHERE n = 1)",
    """fuzzy AS (SELECT ln.artist_name, rf.name, CAST(FLOOR(b.sim * 100.0) AS INTEGER) AS score, 1 AS phase FROM ln JOIN best b ON ln.norm = b.q JOIN rf ON b.c = rf.norm
      WHERE ln.simple NOT IN (SELECT simple FROM rs))""",
    "found AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy)",
    "kept AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY score DESC, phase, artist_name) AS n FROM found) t WHERE n = 1)",
    """matched AS (SELECT v.artist_name, r.name AS right_name, r."artistID" AS right_id, k.name AS right_matched_artist, k.score AS right_match_score
      FROM v_names_left v LEFT JOIN kept k ON v.artist_name = k.artist_name LEFT JOIN v_names_right r ON k.name = r.name)""",
    """fresh AS (SELECT artist_name, ROW_NUMBER() OVER (ORDER BY MD5(artist_name || '|'), artist_name) - 1 + (SELECT MAX("artistID") + 1 FROM v_names_right) AS unified_artist_id
      FROM matched WHERE right_id IS NULL)""",
    """smap AS (SELECT artist_name, right_id AS unified_artist_id FROM matched WHERE right_id IS NOT NULL UNION ALL SELECT artist_name, unified_artist_id FROM fresh)""")


def _matcher(spark, folder, **options):
    return matching.ArtistMatcher(views.names_right(spark, folder), "name", **options)


@query("mat1_simple_names", f"SELECT doc_id, {simple_sql('text')} AS simple FROM documents")
def mat1(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", text.simple_name("text").alias("simple"))


@query("mat2_full_names", f"SELECT doc_id, {full_sql('text')} AS norm FROM documents")
def mat2(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", text.full_name("text").alias("norm"))


@query("mat3_clean_names", f"SELECT page_id, {_CLEAN.format(c='html')} AS cleaned FROM pages")
def mat3(spark, folder):
    return views.table(spark, folder, "pages").select("page_id", text.clean_name("html").alias("cleaned"))


@query("mat4_exact_phase", V_MATCH + """SELECT e.artist_name, r.name, r."artistID", e.score FROM exact e JOIN v_names_right r ON e.name = r.name""")
def mat4(spark, folder):
    rows = matching.exact_matches(views.names_left(spark, folder), "artist_name", views.names_right(spark, folder), "name")
    return rows.select("artist_name", "row.name", "row.artistID", "score")


@query("mat5_block_keys", f"SELECT name, UNNEST({blocks_sql('name')}) AS block FROM (SELECT DISTINCT {full_sql('text')} AS name FROM documents) t")
def mat5(spark, folder):
    names = views.table(spark, folder, "documents").select(text.full_name("text").alias("name")).distinct()
    return matching.blocks_of(names, "name")


@query("mat7_similarity_scorer", f"""SELECT p_partkey, ROUND(1.0::DOUBLE - (LENGTH(a) + LENGTH(b) - 2 * {lcs_sql('a', 'b')}) / (LENGTH(a) + LENGTH(b))::DOUBLE, 9) AS ratio
FROM (SELECT p_partkey, LOWER(p_name) AS a, LOWER(p_type || ' ' || p_brand) AS b FROM part) t""")
def mat7(spark, folder):
    pairs = views.table(spark, folder, "part").select(
        "p_partkey", F.lower("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("b"))
    return pairs.select("p_partkey", r(indel_similarity(F.col("a"), F.col("b")), 9).alias("ratio"))


_BEST_SQL = "SELECT q AS norm, c AS match, ROUND(sim, 9) AS similarity FROM best"


@query("mat6_blocked_candidates", V_MATCH + "SELECT q AS name, c AS match FROM pairs WHERE q IN (SELECT norm FROM hit)")
def mat6(spark, folder):
    """The pairs of names that blocking compares; queries without a common block key are compared to all."""
    matcher = _matcher(spark, folder)
    queries = _open_queries(matcher, views.names_left(spark, folder)).select(F.col("norm").alias("name"))
    known = matching.canonical_rows(matcher.right, "name", text.full_name).select(F.col("norm").alias("name"))
    return matching.blocked_pairs(queries.filter(F.length("name") >= 3), known)


def _open_queries(matcher, left):
    right = matcher.right.select(text.simple_name("name").alias("simple")).distinct()
    named = left.withColumn("simple", text.simple_name("artist_name")).join(right, "simple", "left_anti")
    return named.select(text.full_name("artist_name").alias("norm")).distinct()


@query("mat8_best_match", V_MATCH + _BEST_SQL)
def mat8(spark, folder):
    matcher = _matcher(spark, folder)
    rows = matching.canonical_rows(matcher.right, "name", text.full_name)
    best = matcher.best_norms(_open_queries(matcher, views.names_left(spark, folder)), rows)
    return best.withColumn("similarity", r("similarity", 9))


V_NEAREST = with_views(V_NAMES_RIGHT, V_NAMES_LEFT, f"lc AS (SELECT artist_name, {_CLEAN.format(c='artist_name')} AS q FROM v_names_left)",
    f"rc AS (SELECT DISTINCT {_CLEAN.format(c='name')} AS c FROM v_names_right)",
    f"sims AS (SELECT artist_name, c, 1.0::DOUBLE - (LENGTH(q) + LENGTH(c) - 2 * {lcs_sql('q', 'c')}) / (LENGTH(q) + LENGTH(c))::DOUBLE AS sim FROM lc, rc)",
    "best AS (SELECT artist_name, c, sim FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY artist_name ORDER BY sim DESC, c) AS n FROM sims WHERE sim >= 0.8) t WHERE n = 1)",
    "nearest AS (SELECT l.artist_name, b.c AS spotify_match, COALESCE(b.sim * 100.0, 0.0) AS similarity FROM lc l LEFT JOIN best b ON l.artist_name = b.artist_name)")


@query("mat9_nearest_name", V_NEAREST + "SELECT artist_name, spotify_match, ROUND(similarity, 6) AS similarity FROM nearest")
def mat9(spark, folder):
    nearest = matching.nearest_names(views.names_left(spark, folder), views.names_right(spark, folder), "artist_name", "name")
    return nearest.withColumn("similarity", r("similarity"))


@query("joi11_fuzzy_key_join", V_NEAREST + f"""SELECT n.artist_name, COALESCE(r."artistID", -1) AS "artistID" FROM nearest n
LEFT JOIN v_names_right r ON n.spotify_match = {_CLEAN.format(c='r.name')}""")
def joi11(spark, folder):
    right = views.names_right(spark, folder).withColumn("clean", text.clean_name("name"))
    nearest = matching.nearest_names(views.names_left(spark, folder), right, "artist_name", "name")
    return nearest.join(right, nearest["spotify_match"] == right["clean"], "left").select("artist_name", known_id("artistID"))


@query("mat10_one_to_one", """SELECT p_name AS matched_name, score, phase, left_idx FROM (SELECT p_name, p_size AS score, p_partkey % 2 AS phase, p_partkey AS left_idx,
ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey % 2, p_partkey) AS n FROM part) t WHERE n = 1""")
def mat10(spark, folder):
    given = views.table(spark, folder, "part").select(
        F.col("p_name").alias("matched_name"), F.col("p_size").alias("score"), (F.col("p_partkey") % 2).alias("phase"), F.col("p_partkey").alias("left_idx"))
    return matching.one_to_one(given, "matched_name", "score", ["phase", "left_idx"])


@query("mat11_matched_table", V_MATCH + "SELECT artist_name, right_name, COALESCE(right_id, -1) AS right_id, right_matched_artist, COALESCE(right_match_score, -1) AS right_match_score FROM matched")
def mat11(spark, folder):
    rows = _matcher(spark, folder).match(views.names_left(spark, folder), "artist_name")
    return rows.select("artist_name", "right_name", known_id("right_artistID", "right_id"), "right_matched_artist", known_id("right_match_score"))


@query("mat11_matched_only", V_MATCH + "SELECT artist_name, right_name, right_id, right_matched_artist, right_match_score FROM matched WHERE right_id IS NOT NULL")
def mat11_matched(spark, folder):
    rows = _matcher(spark, folder).match(views.names_left(spark, folder), "artist_name", keep_unmatched=False)
    return rows.withColumnRenamed("right_artistID", "right_id")


def _mapper(spark, folder):
    left, right = views.names_left(spark, folder), views.names_right(spark, folder)
    pairs = matching.ArtistMatcher(right, "name").match(left, "artist_name", keep_unmatched=False)
    return ArtistIDMapper().fit(pairs, right, left, matched_lastfm_col="right_artistID", matched_spotify_col="artist_name")


@query("mat12_unified_ids", V_MATCH + "SELECT artist_name, unified_artist_id FROM smap")
def mat12(spark, folder):
    return _mapper(spark, folder).export_mappings()[1].withColumnRenamed("spotify_artist_name", "artist_name")


@query("mat13_mapping_tables", V_MATCH + """SELECT CAST("artistID" AS VARCHAR) AS source_id, "artistID" AS unified_artist_id, 'lastfm' AS source FROM v_names_right
UNION ALL SELECT artist_name, unified_artist_id, 'spotify' FROM smap""")
def mat13(spark, folder):
    lastfm, spotify = _mapper(spark, folder).export_mappings()
    a = lastfm.select(F.col("lastfm_artist_id").cast("string").alias("source_id"), "unified_artist_id", F.lit("lastfm").alias("source"))
    return a.unionByName(spotify.select(F.col("spotify_artist_name").alias("source_id"), "unified_artist_id", F.lit("spotify").alias("source")))


@query("mat14_mapping_summary", V_MATCH + """SELECT COUNT(*) AS total_unified_ids, (SELECT COUNT(*) FROM v_names_right) AS lastfm_artists, (SELECT COUNT(*) FROM smap) AS spotify_artists,
COUNT(CASE WHEN l IS NOT NULL AND s IS NOT NULL THEN 1 END) AS matched_artists, COUNT(CASE WHEN s IS NULL THEN 1 END) AS unmatched_lastfm,
COUNT(CASE WHEN l IS NULL THEN 1 END) AS unmatched_spotify, MIN(COALESCE(l, s)) AS min_id, MAX(COALESCE(l, s)) AS max_id
FROM (SELECT DISTINCT "artistID" AS l FROM v_names_right) a FULL OUTER JOIN (SELECT DISTINCT unified_artist_id AS s FROM smap) b ON a.l = b.s""")
def mat14(spark, folder):
    return _mapper(spark, folder).get_mapping_summary()


@query("mat15_id_lookup", V_MATCH + """SELECT t.track_id, s.unified_artist_id, COALESCE(r."artistID", -1) AS lastfm_id FROM v_named_tracks t LEFT JOIN smap s ON t.artist_name = s.artist_name
LEFT JOIN v_names_right r ON s.unified_artist_id = r."artistID" """)
def mat15(spark, folder):
    mapper = _mapper(spark, folder)
    tracks = views.named_tracks(spark, folder).select("track_id", "artist_name")
    found = mapper.transform_dataframe(tracks, "artist_name", "auto")
    return mapper.source_ids(found, "unified_artist_id", "lastfm", "lastfm_id").select("track_id", "unified_artist_id", known_id("lastfm_id"))


@query("mat16_unified_mapping", V_MATCH + """SELECT t.artist_name, t.track_id, t.price, s.unified_artist_id FROM v_named_tracks t LEFT JOIN smap s ON t.artist_name = s.artist_name""")
def mat16(spark, folder):
    _, tracks = generate_unified_artist_mappings(
        views.names_right(spark, folder), views.named_tracks(spark, folder), output_lastfm_path=None, output_spotify_path=None)
    return tracks


def words(spark, folder, name):
    """(word): the distinct words of a text table."""
    pieces = F.explode(F.split(text.full_name("text"), " "))
    return views.table(spark, folder, name).select(pieces.alias("word")).filter(F.col("word") != "").distinct()


@query("mat16_vocabulary_mapping")
def mat16_words(spark, folder):
    """The words of all conversations matched to the words of all documents.

    Brute force is out of reach here; tests compare the same join on small fixtures.
    """
    right = words(spark, folder, "documents").select(F.col("word").alias("name"), F.abs(F.xxhash64("word")).alias("artistID"))
    matcher = matching.ArtistMatcher(right, "name")
    rows = matcher.match(words(spark, folder, "conversations"), "word")
    return rows.select("word", "right_matched_artist", "right_match_score")
