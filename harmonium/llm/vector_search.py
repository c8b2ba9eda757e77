"""Nearest vectors by an adaptive scan of dimensions within probed lists (operator 8).

Vectors are scaled to unit length and dealt to the lists of a coarse k-means.  A query is compared to the vectors of its
nearest lists.  There, both are turned by one random rotation and read in blocks of columns.  After a rotation every block
is a random sample of the dimensions, so the distance over the first ones, scaled up, estimates the whole.  After each
block a hypothesis test abandons the candidates whose estimate lies beyond the query's present k-th distance by more
than chance allows.  Survivors are scored on the original vectors in double precision.

Equal vectors are one entry, with as many of their smallest ids as an answer can need; a vector that is shared by a third
of all rows costs one comparison.  Lists are cut into chunks and the queries of a list into blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harmonium.llm.common import materialise, read

K = 5
#: Vectors by which the lists are fitted (those with the smallest digests), lists at most, rounds of k-means.
FIT_ROWS, MOST_LISTS, ROUNDS = 16_384, 1_024, 8
#: Lists probed: this share of all, and at least so many.
PROBED_SHARE, LEAST_PROBED = 0.85, 8
#: Columns of a block, the test's width in standard deviations, rows of a chunk and queries of a block.
COLUMNS, WIDTH, CHUNK = 16, 3.0, 4_096
#: Queries that advance together; pairs are read one by one when this share of them is alive.
TOGETHER, SPARSE = 128, 0.1
SEED = 20


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    scale = np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the squares
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_lists(x: np.ndarray, lists: int, seed: int = SEED) -> np.ndarray:
    """Unit centres of ``lists`` lists; empty ones keep their place."""
    centres = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        at = np.argmax(x @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def survivors(queries: np.ndarray, rows: np.ndarray, k: int, columns: int = COLUMNS, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of each (rotated unit) query's ``k`` nearest rows, with all that tie with the last, in order.

    ``k`` squared distances over all dimensions set the bound, first those of the rows that lead after one block.  Over
    ``d`` of ``D`` dimensions a row is abandoned if its partial sum exceeds ``bound * d / D * (1 + width / sqrt(d)) ** 2``,
    or the bound itself.  The queries advance together: while many rows are alive, a block of columns is one matrix
    product for all of them; later only the pairs alive are read.
    """
    n, d = rows.shape
    r_squares, q_squares = rows * rows, queries * queries

    def block(start: int, end: int) -> np.ndarray:
        q, r = queries[:, start:end], rows[:, start:end]
        return q_squares[:, start:end].sum(1)[:, None] + r_squares[:, start:end].sum(1) - 2 * (q @ r.T)

    part = block(0, min(columns, d))
    lead = np.argpartition(part, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), part.shape)
    bound = ((rows[lead] - queries[:, None]) ** 2).sum(2).max(1)
    pairs = None  # (query, row, partial sum) once few are alive
    for done in range(columns, d + columns, columns):
        at = min(done, d)
        most = bound * min(1.0, at / d * (1 + width / math.sqrt(at)) ** 2) + 1e-9
        upto = min(at + columns, d)
        if pairs is None:
            alive = part <= most[:, None]
            if at == d or np.count_nonzero(alive) > SPARSE * alive.size:
                part[~alive] = np.inf
                part += block(at, upto) if at < d else 0
                continue
            q, r = np.nonzero(alive)
            pairs = q, r, part[q, r]
        else:
            keep = pairs[2] <= most[pairs[0]]
            pairs = tuple(x[keep] for x in pairs)
        if at < d:
            q, r, p = pairs
            pairs = q, r, p + ((rows[r, at:upto] - queries[q, at:upto]) ** 2).sum(1)
    if pairs is not None:
        part = np.full(part.shape, np.inf)
        part[pairs[0], pairs[1]] = pairs[2]
    last = np.partition(part, k - 1, axis=1)[:, k - 1] + 1e-9 if n > k else np.full(len(part), np.inf)
    return np.nonzero((part <= last[:, None]) & (part < np.inf))


def cosines(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Cosines of pairs of vectors, each scaled by a power of two, which rounds nothing and keeps the squares in range."""
    scaled = [np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (np.asarray(queries, np.float64), np.asarray(rows, np.float64))]
    norms = [np.sqrt((x * x).sum(1)) for x in scaled]
    return (scaled[0][q] * scaled[1][r]).sum(1) / (norms[0][q] * norms[1][r])


class VectorSearch:
    """``search(table, queries)``: both have ``vec_id`` and ``embedding``; other columns are not read.

    Returns query_id, rank, vec_id, score; of equal scores the smaller vec_id comes first, a query's own id is never among
    its answers.  Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do rows
    without a vec_id; only vectors of one length are compared.  Repeated rows with one vec_id are one.  Empty tables give
    an empty result; fewer candidates give fewer answers.
    """

    def __init__(self, k: int = K, probed_share: float = PROBED_SHARE, columns: int = COLUMNS, width: float = WIDTH):
        self.k, self.probed_share, self.columns, self.width = k, probed_share, columns, width

    def search(self, table: DataFrame, queries: DataFrame) -> DataFrame:
        usable = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
            "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
        # -0.0 and 0.0 are one vector's component
        plain = lambda df: df.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
        rows, asked = plain(usable(table)), plain(usable(queries))
        first = W.partitionBy("embedding").orderBy("vec_id")
        ids = rows.select("embedding", "vec_id").withColumn("place", F.dense_rank().over(first)).where(F.col("place") <= self.k + 1).dropDuplicates(["embedding", "vec_id"])
        ids = materialise(ids.withColumn("entry", F.min("vec_id").over(W.partitionBy("embedding"))), "entries")
        entries = ids.where("vec_id = entry").select("entry", "embedding")
        asked = materialise(asked.dropDuplicates(["vec_id", "embedding"]).join(entries.withColumnRenamed("entry", "known"), "embedding", "left").withColumn("entry", F.coalesce("known", "vec_id")), "asked")
        targets = asked.select("entry", "embedding").dropDuplicates(["entry"])
        parts = [self._one_length(entries.where(F.size("embedding") == d), targets.where(F.size("embedding") == d), d)
                 for d in sorted(r[0] for r in entries.select(F.size("embedding")).distinct().collect())]
        if not parts:
            return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        by = lambda key: W.partitionBy(key).orderBy(F.desc("score"), "vec_id")
        near = found.withColumnRenamed("found", "entry_found").join(ids.select(F.col("entry").alias("entry_found"), "vec_id"), "entry_found").select("entry", "vec_id", "score")
        near = near.withColumn("rank", F.row_number().over(by("entry"))).where(F.col("rank") <= self.k + 1).drop("rank")
        answers = asked.select(F.col("vec_id").alias("query_id"), "entry").join(near, "entry").where("vec_id <> query_id")
        return answers.withColumn("rank", F.row_number().over(by("query_id"))).where(F.col("rank") <= self.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def _one_length(self, entries: DataFrame, targets: DataFrame, d: int) -> DataFrame:
        spark = entries.sparkSession
        n = entries.count()
        sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(FIT_ROWS).toPandas()
        x = unit(np.stack(sample["embedding"].to_numpy()))
        lists = max(1, min(MOST_LISTS, len(x), round(math.sqrt(n) / 2)))
        shared = spark.sparkContext.broadcast(fit_lists(x, lists))
        probed = min(lists, max(LEAST_PROBED, round(lists * self.probed_share)))

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            return pd.Series(np.argmax(unit(np.stack(v.to_numpy())) @ shared.value.T, 1).astype(np.int32), index=v.index) if len(v) else pd.Series([], dtype="int32")

        listed = materialise(entries.withColumn("list", nearest("embedding")), "lists")
        sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # at most MOST_LISTS
        held = np.array([sizes.get(i, 0) for i in range(lists)])
        k = self.k

        @F.pandas_udf("array<int>")
        def probes(v: pd.Series) -> pd.Series:
            out = []
            if len(v):
                order = np.argsort(-(unit(np.stack(v.to_numpy())) @ shared.value.T), 1, kind="stable")
                for row in order:
                    row = row[held[row] > 0]
                    # as many more lists as the answer needs entries
                    most = max(probed, int(np.searchsorted(np.cumsum(held[row]), k + 1)) + 1)
                    out.append(row[:most].astype(np.int32))
            return pd.Series(out, index=v.index, dtype=object)

        asks = materialise(targets.withColumn("list", F.explode(probes("embedding"))), "asks")
        asked = {r["list"]: r["count"] for r in asks.groupBy("list").count().collect()}
        chunks = [max(1, -(-sizes.get(i, 0) // CHUNK)) for i in range(lists)]
        blocks = [max(1, -(-asked.get(i, 0) // CHUNK)) for i in range(lists)]
        cut = spark.createDataFrame([(i, c, b) for i, (c, b) in enumerate(zip(chunks, blocks, strict=True))], "list int, chunks int, blocks int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("entry"), F.col(c).cast("long")).cast("int")
        left = asks.join(F.broadcast(cut), "list").withColumn("block", own("blocks")).withColumn("chunk", every("chunks"))
        right = listed.join(F.broadcast(cut), "list").withColumn("chunk", own("chunks")).withColumn("block", every("blocks"))
        turn = spark.sparkContext.broadcast(rotation(d))
        columns, width = self.columns, self.width

        def compare(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            asked_for, ids = q["entry"].to_numpy(), v["entry"].to_numpy()
            out = {"entry": [np.empty(0, np.int64)], "found": [np.empty(0, np.int64)], "score": [np.empty(0)]}
            if len(q) and len(v):
                wanted, held_here = np.stack(q["embedding"].to_numpy()), np.stack(v["embedding"].to_numpy())
                turned, near = unit(wanted) @ turn.value, unit(held_here) @ turn.value
                for start in range(0, len(wanted), TOGETHER):
                    at, found = survivors(turned[start : start + TOGETHER], near, k + 1, columns, width)
                    out["entry"].append(asked_for[start + at])
                    out["found"].append(ids[found])
                    out["score"].append(cosines(wanted[start : start + TOGETHER], held_here, at, found))
            return pd.DataFrame({c: np.concatenate(x) for c, x in out.items()})

        keys = ["list", "chunk", "block"]
        return left.select(*keys, "entry", "embedding").groupBy(*keys).cogroup(right.select(*keys, "entry", "embedding").groupBy(*keys)).applyInPandas(compare, "entry long, found long, score double")


def op8_adaptive_scan(spark: SparkSession, folder: str) -> DataFrame:
    table = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return VectorSearch().search(table, table.where("vec_id % 50 = 0"))
