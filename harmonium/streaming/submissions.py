"""Rating submissions: validation, and a store in which the latest one per user counts.

The same column expressions run on batches and streams.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harmonium.sources.manifest import Manifest

SUBMISSION_SCHEMA = (
    "submission_id BIGINT, user_id STRING, submitted_at TIMESTAMP, ratings ARRAY<STRUCT<artist_id: BIGINT, rank: INT>>"
)
MAX_SURVEY = 1000


def survey_ids(survey: DataFrame | Sequence[int], item_col: str = "artist_id") -> list[int]:
    """The survey's artists; a survey is a short fixed list, which is checked."""
    if not isinstance(survey, DataFrame):
        return sorted(survey)
    rows = survey.select(F.col(item_col).cast("bigint")).distinct().limit(MAX_SURVEY + 1).collect()
    if len(rows) > MAX_SURVEY:
        raise ValueError(f"a survey lists at most {MAX_SURVEY} artists")
    return sorted(r[0] for r in rows)


def from_ordered_list(df: DataFrame, artists_col: str = "artists") -> DataFrame:
    """Submissions given as ordered artist lists: the position is the rank."""
    ranked = F.transform(artists_col, lambda a, i: F.struct(a.cast("bigint").alias("artist_id"), (i + 1).cast("int").alias("rank")))
    return df.withColumn("ratings", ranked).drop(artists_col)


def rejection_reason(survey: Sequence[int]) -> Column:
    """The first rule a submission breaks, or null."""
    ratings, user = F.col("ratings"), F.col("user_id")
    artists = F.transform(ratings, lambda r: r["artist_id"])
    ranks = F.transform(ratings, lambda r: r["rank"])
    unknown = F.array_sort(F.filter(artists, lambda a: ~a.isin(list(survey)) if survey else F.lit(True)))
    listed = F.concat(F.lit("Invalid artist IDs: ["), F.array_join(F.array_distinct(unknown).cast("array<string>"), ", "), F.lit("]"))
    bad_rank = F.exists(ranks, lambda r: r.isNull() | ~r.between(1, 10))
    return (
        F.when(user.isNull() | ~F.length(user).between(1, 100), "user_id must have 1 to 100 characters")
        .when(ratings.isNull() | ~F.size(ratings).between(1, 10), "1 to 10 ratings are required")
        .when(F.exists(artists, lambda a: a.isNull()), "artist_id is required")
        .when(bad_rank, "rank must be between 1 and 10")
        .when(F.size(F.array_distinct(artists)) < F.size(artists), "Duplicate artist IDs found in ratings")
        .when(F.size(F.array_distinct(ranks)) < F.size(ranks), "Duplicate ranks found. Each artist must have a unique rank")
        .when(F.size(unknown) > 0, listed)
    )


def validate(submissions: DataFrame, survey: DataFrame | Sequence[int]) -> DataFrame:
    """Submissions with ``valid`` and ``reason``."""
    return submissions.withColumn("reason", rejection_reason(survey_ids(survey))).withColumn("valid", F.col("reason").isNull())


def latest_per_user(submissions: DataFrame) -> DataFrame:
    """The last submission of each user by time, then id."""
    others = [c for c in submissions.columns if c not in ("user_id", "submitted_at", "submission_id")]
    newest = F.max(F.struct("submitted_at", "submission_id", *others)).alias("s")
    return submissions.groupBy("user_id").agg(newest).select("user_id", "s.*").select(*submissions.columns)


def with_epoch(ranges: list[list[int]], epoch: int) -> list[list[int]]:
    """Sorted ranges [first, last] of epochs, with one more; epochs that follow each other share a range."""
    out: list[list[int]] = []
    for first, last in sorted([*ranges, [epoch, epoch]]):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _holds(ranges: list[list[int]], epoch: int) -> bool:
    return any(first <= epoch <= last for first, last in ranges)


class RatingStore:
    """A log of Parquet parts of which a manifest names the live ones.

    Every save, deletion and compaction writes parts under new names and then commits, so nothing is ever overwritten and
    readers see each step whole.  A batch is known by its run and epoch: replayed, it takes the place of its first attempt.
    Reading keeps the newest row per user; deletions are rows too, so a submission older than a deletion stays away.
    """

    columns = ("user_id", "submitted_at", "submission_id", "ratings")
    _SCHEMA = "user_id STRING, submitted_at TIMESTAMP, submission_id BIGINT, ratings ARRAY<STRUCT<artist_id: BIGINT, rank: INT>>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.manifest = Manifest(spark, self.path)

    def _write(self, rows: DataFrame) -> str:
        name = f"parts/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def live(self) -> list[dict]:
        """The live parts: name, and run and epoch of a batch."""
        return (self.manifest.read() or {"parts": []})["parts"]

    def save(self, batch: DataFrame, epoch: int, run: str = "direct") -> None:
        """Add a batch; a batch that a compaction has taken in already is left alone."""
        folded = (self.manifest.read() or {}).get("folded", {})
        if _holds(folded.get(run, []), epoch):
            return
        part = {"name": self._write(latest_per_user(batch.select(*self.columns))), "run": run, "epoch": epoch}

        def add(state: dict | None) -> dict | None:
            state = state or {"parts": [], "folded": {}}
            if _holds(state["folded"].get(run, []), epoch):
                return None
            others = [p for p in state["parts"] if (p["run"], p["epoch"]) != (run, epoch)]
            return {**state, "parts": [*others, part]}

        self.manifest.commit(add)

    def _read(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self._SCHEMA)
        return self.spark.read.schema(self._SCHEMA).parquet(*[f"{self.path}/{p['name']}" for p in parts])

    def load(self) -> DataFrame:
        """The newest submission per user; deleted users are left out."""
        return latest_per_user(self._read(self.live())).filter(F.col("ratings").isNotNull())

    def has_ratings(self, users: DataFrame) -> DataFrame:
        """Requested users with ``exists``."""
        known = self.load().select("user_id", F.lit(True).alias("exists"))
        return users.join(known, "user_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))

    def delete(self, users: DataFrame, epoch: int = 0, deleted_at: Column | None = None) -> None:
        """Mark users as deleted; an older submission does not come back.

        Each deletion is a part of its own, also if several are given the same ``epoch``.
        """
        marks = users.select(
            "user_id", (deleted_at if deleted_at is not None else F.current_timestamp()).alias("submitted_at"),
            F.lit(9223372036854775807).cast("bigint").alias("submission_id"),
            F.lit(None).cast("array<struct<artist_id: bigint, rank: int>>").alias("ratings"))
        self.save(marks, epoch, f"deletion-{uuid.uuid4().hex}")

    def compact(self, path: str | None = None) -> "RatingStore":
        """Fold the live parts into one, deletions included; parts that others add meanwhile stay beside it.

        With a ``path`` this store stays as it is and the folded part becomes the first of a new one there.
        """
        parts = self.live()
        if path is not None:
            target = RatingStore(self.spark, path)
            target.save(self._read(parts), 0)
            return target
        if len(parts) > 1:
            whole = {"name": self._write(latest_per_user(self._read(parts))), "run": "compact", "epoch": uuid.uuid4().int % 2**53}
            taken = {p["name"] for p in parts}

            def fold(state: dict) -> dict | None:
                now = {p["name"] for p in state["parts"]}
                if not taken <= now:
                    return None  # another compaction or a replayed batch changed what was read
                folded = dict(state["folded"])
                for p in parts:
                    if p["run"] != "compact" and not p["run"].startswith("deletion-"):
                        folded[p["run"]] = with_epoch(folded.get(p["run"], []), p["epoch"])
                return {"parts": [whole, *[p for p in state["parts"] if p["name"] not in taken]], "folded": folded}

            self.manifest.commit(fold)
        return self

    def vacuum(self, keep: int = 2) -> int:
        """Delete the parts that only versions before the last ``keep`` name; returns how many it removed."""
        versions = self.manifest.versions()
        named = [{p["name"] for p in self.manifest.read(v)["parts"]} for v in versions]
        gone = set().union(*named[:-keep]) - set().union(*named[-keep:]) if len(named) > keep else set()
        return sum(self.manifest.delete(name) for name in gone)


def stream_submissions(spark: SparkSession, folder: str, schema: str = SUBMISSION_SCHEMA) -> DataFrame:
    """JSON submissions that arrive as files."""
    return spark.readStream.schema(schema).json(folder)


def run_store(submissions: DataFrame, survey: DataFrame | Sequence[int], store: RatingStore, checkpoint: str,
              rejected_path: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Validate a stream of submissions into the store, and rejected ones into their own folder."""
    checked = validate(submissions, survey)

    def write(batch: DataFrame, epoch: int) -> None:
        # the id that Spark keeps in the checkpoint: restarts have it too, a new checkpoint has another, also at the same path
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store.save(batch.filter("valid"), epoch, run)
        if rejected_path:
            batch.filter(~F.col("valid")).write.mode("overwrite").parquet(f"{rejected_path}/run={run}/epoch={epoch}")

    return (
        checked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
