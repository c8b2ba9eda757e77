"""The whole mapping job: distinct names, matching, ids, attached to both sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmonium.operators.idmap import ArtistIDMapper
from harmonium.operators.joins import attach_unified_id
from harmonium.operators.matching import ArtistMatcher
from harmonium.sources.writers import write_parquet


def generate_unified_artist_mappings(
    lastfm_artists_df: DataFrame,
    spotify_tracks_df: DataFrame,
    lastfm_artist_name_col: str = "name",
    lastfm_artist_id_col: str = "artistID",
    spotify_artist_name_col: str = "artist_name",
    output_lastfm_path: str | None = "../data/lastfm_unified_artists.parquet",
    output_spotify_path: str | None = "../data/spotify_unified_artists.parquet",
    score_cutoff: float = 85,
    scorer: str = "ratio",
) -> tuple[DataFrame, DataFrame]:
    """(artists with unified ids, tracks with unified ids); written where a path is given."""
    names = spotify_tracks_df.select(spotify_artist_name_col).distinct()
    matcher = ArtistMatcher(lastfm_artists_df, lastfm_artist_name_col, score_cutoff, scorer)
    matched = matcher.match(names, spotify_artist_name_col, keep_unmatched=False)
    pairs = matched.select(F.col(f"right_{lastfm_artist_id_col}").alias(lastfm_artist_id_col), spotify_artist_name_col)

    mapper = ArtistIDMapper().fit(
        pairs, lastfm_artists_df, names, lastfm_id_col=lastfm_artist_id_col, spotify_id_col=spotify_artist_name_col,
        matched_lastfm_col=lastfm_artist_id_col, matched_spotify_col=spotify_artist_name_col,
    )
    lastfm_map, spotify_map = mapper.export_mappings()
    artists = lastfm_artists_df.select(
        F.col(lastfm_artist_name_col).alias("lastfm_artist_name"), F.col(lastfm_artist_id_col).alias("lastfm_artist_id"))
    artists = attach_unified_id(artists, lastfm_map, "lastfm_artist_id", "lastfm_artist_id").select(
        "lastfm_artist_name", "lastfm_artist_id", "unified_artist_id")
    tracks = attach_unified_id(spotify_tracks_df, spotify_map, spotify_artist_name_col, "spotify_artist_name").select(
        *spotify_tracks_df.columns, "unified_artist_id")
    if output_lastfm_path:
        write_parquet(artists, output_lastfm_path)
    if output_spotify_path:
        write_parquet(tracks, output_spotify_path)
    return artists, tracks
