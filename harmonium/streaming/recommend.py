"""Recommendations for the users of a request table or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harmonium.operators.scoring import RecommendationService
from harmonium.session import materialise
from harmonium.streaming.submissions import RatingStore

MAX_TOP_K = 50


def exploded_ratings(submissions: DataFrame) -> DataFrame:
    """(user_id, artist_id, rank) rows of stored submissions."""
    return submissions.select("user_id", F.inline("ratings"))


def generate_recommendations(requests: DataFrame, submissions: DataFrame, service: RecommendationService,
                             top_k: int = 10) -> DataFrame:
    """(user_id, status, rank, artistID, artist_name, score) for every requested user.

    A user without ratings gets one row that says so.
    """
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")
    users = requests.select("user_id").distinct()
    submitted = materialise(submissions.join(users, "user_id", "left_semi"), "requested")
    vectors = service.create_user_vector_from_survey(exploded_ratings(submitted))
    best = service.get_recommendations(vectors, top_k)
    missing = F.concat(F.lit("No ratings found for user "), F.col("user_id"), F.lit(". Please submit ratings first."))
    rated = submitted.select("user_id", F.lit(True).alias("rated"))
    answered = users.join(rated, "user_id", "left").join(best, "user_id", "left")
    status = F.when(F.col("rated").isNull(), missing).when(F.col("rank").isNull(), "User vector has no preferences!").otherwise("ok")
    return answered.select("user_id", status.alias("status"), "rank", "artistID", "artist_name", "score")


def run_recommendations(requests: DataFrame, store: RatingStore, service: RecommendationService, path: str,
                        checkpoint: str, top_k: int = 10, trigger: dict | None = None) -> StreamingQuery:
    """Answer a stream of requests (user_id) against the current store, one folder per batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        generate_recommendations(batch, store.load(), service, top_k).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
