"""Hard negatives by segment summaries (operator 13).

A vector is cut into segments; of each the mean and the deviation (the length of what remains when the mean is taken off)
are stored.  The inner product of two segments lies within ``length * mean * mean`` plus or minus ``deviation * deviation``,
so a few numbers bound a score from both sides.  Segments are halved level by level: a row whose bounds reach none of the
wanted windows of scores is dropped before the next, finer level, and only what the finest level leaves is scored
exactly, on the vectors themselves.  Bounds may only lose rows that cannot be among the answers, so results are exact.

Anchors, in blocks, meet all rows, in chunks; each pair of a block and a chunk is one task's matrix work and hands on at
most k rows for each window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harmonium.llm.common import materialise, prepared, read

#: Positives of an anchor, negatives of a positive, window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Components are multiplied by this and rounded down to whole numbers.
SCALE = 256
#: Anchors of a block, rows of a chunk, dimensions of a finest segment.
BLOCK, CHUNK, FINEST = 512, 8_192, 2
_MOST = 2**63 - 1


def levels(d: int, finest: int = FINEST) -> list[np.ndarray]:
    """Borders of the segments, level by level: 1, 2, 4, ... segments until they are at most ``finest`` long."""
    out, n = [], 1
    while True:
        out.append(np.unique(np.linspace(0, d, n + 1).astype(int)))
        if n >= d or -(-d // n) <= finest:
            return out
        n *= 2


def summaries(x: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means times the root of the segment's length, and deviations, of each row's segments.

    With that scaling the mean parts of a score are a plain inner product.
    """
    lengths = np.diff(borders)
    total = np.add.reduceat(x, borders[:-1], axis=1)
    squares = np.add.reduceat((x - np.repeat(total / lengths, lengths, axis=1)) ** 2, borders[:-1], axis=1)
    return total / np.sqrt(lengths), np.sqrt(squares)


def exact_scores(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole-number inner products; those that pass 64 bits are held at the limit."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.abs(a) @ np.abs(rows).max(0, initial=0) if len(rows) else 0.0
    if size < 2.0**53:
        return (rows @ a).astype(np.int64)
    whole = [int(v) for v in a]
    return np.array([max(-_MOST, min(_MOST, sum(x * int(y) for x, y in zip(whole, row, strict=True)))) for row in rows], np.int64)


class Scan:
    """Rows of a chunk with their summaries at every level."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, finest: int = FINEST):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.order = order
        self.levels = levels(x.shape[1], finest)
        with np.errstate(over="ignore", invalid="ignore"):
            self.stored = [summaries(self.x, b) for b in self.levels]
        self.scored = 0  # rows that were scored exactly

    def best(self, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the places and scores of the ``k`` best masked rows with low <= score <= high."""
        alive = np.flatnonzero(mask)
        # a window that ends at the limit holds all scores beyond
        low = np.array([-np.inf if w[0] <= -_MOST else float(w[0]) for w in windows])
        high = np.array([np.inf if w[1] >= _MOST else float(w[1]) for w in windows])
        for borders, (means, spread) in zip(self.levels, self.stored, strict=True):
            if len(alive) <= k:
                break
            with np.errstate(over="ignore", invalid="ignore"):  # huge numbers make a bound infinite or unknown, which drops nothing
                mine, own = summaries(anchor[None, :], borders)
                centre, reach = means[alive] @ mine[0], spread[alive] @ own[0]
                slack = 1e-9 * (np.abs(means[alive]) @ np.abs(mine[0]) + reach) + 1e-6
                least, most = centre - reach - slack, centre + reach + slack
            keep = np.zeros(len(alive), bool)
            for i in range(len(windows)):
                sure = least[(least >= low[i]) & (most <= high[i])]
                if len(sure) >= k:  # so many rows are in the window for certain: the k-th best of them is a new lower end
                    low[i] = max(low[i], min(np.partition(sure, len(sure) - k)[len(sure) - k], 9e18))  # scores held at the limit tie
                keep |= ~(most < low[i]) & ~(least > high[i])
            alive = alive[keep]
        self.scored += len(alive)
        score = exact_scores(anchor, self.x[alive])
        for bottom, top in windows:
            fits = np.flatnonzero((score >= bottom) & (score <= top))
            fits = fits[np.lexsort((alive[fits], -score[fits]))][:k]  # places are in the order of ids
            yield alive[fits], score[fits]


def _vectors(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


class HardNegatives:
    """``mine(table, anchors)``: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels.

    ``table`` has ``vec_id``, ``label`` and ``embedding``; ``anchors`` is a condition on its columns; other columns are not
    read.  Scores are inner products of the components, scaled and rounded down; ties go to the smaller vec_id.  A negative
    lies within ``low`` to ``high`` hundredths of its positive's score, so a positive below 0 has none.  Rows with a null
    vec_id, label or vector, with an empty one or with a null or non-finite component (also after scaling) take no part;
    only vectors of one length are compared.  Of rows with one vec_id the one with the smallest label and vector counts.
    An empty table, an anchor without positives and a positive without negatives give no rows.
    """

    def __init__(self, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
                 block: int = BLOCK, chunk: int = CHUNK, finest: int = FINEST):
        self.positives, self.negatives, self.low, self.high, self.scale = positives, negatives, low, high, scale
        self.block, self.chunk, self.finest = block, chunk, finest

    def _prepared(self, table: DataFrame, anchors: Column) -> DataFrame:
        """(vec_id, label, size, anchor, vector): whole components as packed doubles."""
        rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), anchors.alias("anchor"))
        rows = rows.where(f"vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x * {self.scale}) < double('infinity'))")
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "anchor")).alias("r")).select("vec_id", "r.label", F.size("r.embedding").alias("size"), "r.embedding", F.coalesce("r.anchor", F.lit(False)).alias("anchor"))
        scale = float(self.scale)

        @F.pandas_udf("binary")
        def packed(v: pd.Series) -> pd.Series:
            return pd.Series([np.floor(scale * np.asarray(x, np.float64)).tobytes() for x in v], index=v.index, dtype=object)

        return materialise(rows.withColumn("vector", packed("embedding")).drop("embedding"), "vectors")

    def _meet(self, asked: DataFrame, rows: DataFrame, keys: list[str], same: bool, k: int) -> DataFrame:
        """Best rows of every chunk for the windows of ``asked`` (keys, vec_id, label, vector, windows)."""
        spark = asked.sparkSession
        sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / self.chunk).cast("int").alias("chunks"))
        blocks = asked.groupBy(*keys).agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks"))
        cut = materialise(sizes.join(blocks, keys), "cuts")  # a row for each label and length
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c).cast("long")).cast("int")
        left = asked.join(cut, keys).withColumn("block", own("blocks")).withColumn("chunk", every("chunks"))
        right = rows.join(cut, keys).withColumn("chunk", own("chunks")).withColumn("block", every("blocks"))
        by, finest = [*keys, "block", "chunk"], self.finest

        def compare(key, a: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(a) and len(v):
                scan = Scan(v["vec_id"].to_numpy(), _vectors(v["vector"]), finest)
                labels = v["label"].to_numpy()[scan.order]
                for anchor, label, vector, lows, highs in zip(a["vec_id"], a["label"], _vectors(a["vector"]), a["lows"], a["highs"], strict=True):
                    mask = (labels == label) & (scan.ids != anchor) if same else labels != label
                    windows = list(zip(map(int, lows), map(int, highs), strict=True))
                    for window, (at, score) in enumerate(scan.best(vector, windows, k, mask)):
                        if len(at):
                            out.append(pd.DataFrame({"anchor_id": anchor, "window": window, "vec_id": scan.ids[at], "score": score}))
            return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "window": [], "vec_id": [], "score": []}).astype("int64")

        columns = list(dict.fromkeys([*by, "vec_id", "label", "vector"]))
        found = left.select(*columns, "lows", "highs").groupBy(*by).cogroup(right.select(*columns).groupBy(*by))
        found = found.applyInPandas(compare, "anchor_id long, window int, vec_id long, score long")
        best = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def mine(self, table: DataFrame, anchors: Column) -> DataFrame:
        """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
        rows = self._prepared(table, anchors)
        asked = materialise(rows.where("anchor"), "anchors")
        whole = asked.withColumn("lows", F.array(F.lit(-_MOST))).withColumn("highs", F.array(F.lit(_MOST)))
        positives = materialise(self._meet(whole, rows, ["label", "size"], True, self.positives).select("anchor_id", F.col("vec_id").alias("positive_id"), "score", "rank"), "positives")
        # whole-number ends of the window low * positive <= 100 * negative <= high * positive, in arithmetic that cannot overflow
        wide, hundred = F.col("score").cast("decimal(20,0)"), F.lit(100).cast("decimal(3,0)")
        floor = lambda share: F.floor(wide * F.lit(share).cast("decimal(9,0)") / hundred).cast("decimal(30,0)")
        ceiling = lambda share: F.ceil(wide * F.lit(share).cast("decimal(9,0)") / hundred).cast("decimal(30,0)")
        most = F.lit(_MOST).cast("decimal(30,0)")
        limited = lambda c: F.greatest(-most, F.least(most, c)).cast("long")
        window = positives.where(ceiling(self.low) <= floor(self.high)).select("anchor_id", F.struct("rank", "positive_id", "score", limited(ceiling(self.low)).alias("low"), limited(floor(self.high)).alias("high")).alias("w"))
        windows = window.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list("w")).alias("ws"))  # at most ``positives`` an anchor
        wanted = materialise(asked.join(windows, "vec_id").select("*", F.col("ws.low").alias("lows"), F.col("ws.high").alias("highs")), "windows")
        found = self._meet(wanted, rows, ["size"], False, self.negatives)
        return found.join(wanted.select(F.col("vec_id").alias("anchor_id"), "ws"), "anchor_id").select(
            "anchor_id", F.element_at("ws", F.col("window") + 1)["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            F.element_at("ws", F.col("window") + 1)["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op13_segment_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives in ``embeddings`` for every hundredth vec_id; every seventh row takes the next label first."""
    table = read(prepared(spark), folder, "embeddings").select("vec_id", "label", "embedding")
    table = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return HardNegatives().mine(table, F.col("vec_id") % 100 == 0)


OP13_SQL = f"""WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, LIST_TRANSFORM(embedding, lambda x: FLOOR({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, LIST_DOT_PRODUCT(a.v, r.v)::BIGINT AS score FROM rows a, rows r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM pairs WHERE same) t WHERE place <= {POSITIVES}),
negatives AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {NEGATIVES}"""
