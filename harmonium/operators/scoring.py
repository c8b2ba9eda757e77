"""Scoring users against items: top-k lists, AUC and cold-start vectors.

Scoring is dense linear algebra, so it runs in numpy on blocks: blocks of users
meet blocks of items in an equi-join on block numbers, each block pair gives
one matrix product, and only k rows per user leave it.  Neither side is
broadcast and no user-item pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmonium.functions.scalars import rank_weight
from harmonium.operators import ranking
from harmonium.operators.joins import lookup_name
from harmonium.session import materialise

USER_BLOCK = 512
ITEM_BLOCK = 2048
#: bytes of item factors one task holds
GROUP_BYTES = 256 << 20
#: with more items, item blocks that cannot reach a user's list are left out; ranges of reach they are dealt into
BOUNDED_FROM, REACH_RANGES = 4 * ITEM_BLOCK, 256
#: scores of one user's positives that one row carries
POSITIVES = 10_000


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _blocks(rows: DataFrame, id_col: str, size: int, prefix: str, extra: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """Rows packed into blocks of about ``size``: block, ids, flat factors, biases, and ``extra`` aggregates.

    Rows that come with a column ``iblock`` are dealt already.
    """
    count = max(1, -(-rows.count() // size))
    block = F.col("iblock") if "iblock" in rows.columns else F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int")
    one = F.struct(F.col(id_col).alias("id"), "factors", "bias")
    extra = extra or {}
    packed = rows.groupBy(block.alias(f"{prefix}block")).agg(F.collect_list(one).alias("rows"), *[c.alias(n) for n, c in extra.items()])
    return packed.select(
        f"{prefix}block", *extra,
        F.transform("rows", lambda r: r["id"]).alias(f"{prefix}ids"),
        F.flatten(F.transform("rows", lambda r: r["factors"])).alias(f"{prefix}flat"),
        F.transform("rows", lambda r: r["bias"]).alias(f"{prefix}bias"),
    ), count


def _with_bias(rows: DataFrame, id_col: str) -> DataFrame:
    bias = F.col("bias").cast("double") if "bias" in rows.columns else F.lit(0.0)
    return rows.select(id_col, F.col("factors").cast("array<double>").alias("factors"), bias.alias("bias"))


def _block_pairs(users: DataFrame, items: DataFrame, user_col: str, item_col: str) -> DataFrame:
    """Every user block next to every item block, spread over (item group, user lane) keys.

    With columns ``least`` (see ``_least_scores``) and ``reach`` (see ``_by_reach``) block pairs without a possible entry are left out.
    """
    bounded = "least" in users.columns
    left, n_users = _blocks(users, user_col, USER_BLOCK, "u", {"u_least": F.min(F.col("least") - F.col("bias")), "u_long": F.max("length")} if bounded else None)
    right, n_items = _blocks(items, item_col, ITEM_BLOCK, "i", {c: F.max(c.removeprefix("i_")) for c in ("i_reach", "i_bias", "i_length")} if bounded else None)
    width = items.select(F.max(F.size("factors"))).first()[0] or 1
    tasks = 4 * users.sparkSession.sparkContext.defaultParallelism
    # Users are sent once per item group, items once per user lane: as few groups as memory allows,
    # more only when there are too few user blocks to keep all cores busy.
    groups = min(n_items, -(-n_items * ITEM_BLOCK * width * 8 // GROUP_BYTES))
    lanes = max(1, min(n_users, -(-tasks // groups)))
    groups = max(groups, min(n_items, -(-tasks // lanes)))
    left = left.withColumn("lane", F.pmod(F.col("ublock"), F.lit(lanes)))
    left = left.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = right.withColumn("group", F.pmod(F.col("iblock"), F.lit(groups)))
    right = right.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    pairs = left.join(right.hint("shuffle_hash"), ["group", "lane"])
    if not bounded:
        return pairs
    product = F.col("i_length") * F.col("u_long")
    slack = F.lit(1e-9) * (F.abs(product) + F.abs("i_bias") + F.abs("u_least") + 1)  # for what rounding can do
    possible = F.least("i_reach", F.col("i_bias") + product) + slack >= F.col("u_least")
    return pairs.where(F.coalesce(possible, F.lit(True))).drop("u_least", "u_long", "i_reach", "i_bias", "i_length")


def _length() -> Column:
    return F.sqrt(dot("factors", "factors"))


def _by_reach(users: DataFrame, items: DataFrame, item_col: str) -> DataFrame | None:
    """``items`` with their block, length and reach: no user's score of an item, without the user's bias, is above it.

    By Cauchy and Schwarz that is the bias and the product of the lengths.  Blocks hold items of similar reach.  None, if a
    user's length is not a finite number.
    """
    longest = users.agg(F.max(_length())).first()[0]
    if longest is None or not np.isfinite(longest):
        return None
    reach = F.coalesce(F.col("bias") + F.col("length") * F.lit(longest), F.lit(float("inf")))
    items = materialise(items.withColumn("length", F.coalesce(_length(), F.lit(float("inf")))).withColumn("reach", reach), "score-reach")
    ranges = min(REACH_RANGES, -(-items.count() // ITEM_BLOCK))
    edges = sorted(set(items.approxQuantile("reach", [i / ranges for i in range(1, ranges)], 0.001)))
    items = items.withColumn("range", F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("reach"))) if edges else F.lit(0))
    sizes = dict(items.groupBy("range").count().collect())  # one row a range
    parts = [max(1, -(-sizes.get(i, 0) // ITEM_BLOCK)) for i in range(len(edges) + 1)]
    starts = np.concatenate([[0], np.cumsum(parts)[:-1]]).tolist()
    of = lambda numbers: F.get(F.array(*[F.lit(n) for n in numbers]), F.col("range"))
    block = (of(starts) + F.pmod(F.xxhash64(item_col), of(parts))).cast("int")
    return materialise(items.withColumn("iblock", block).drop("range"), "score-dealt")


def _matrix(row: pa.RecordBatch, i: int, prefix: str) -> tuple[np.ndarray, np.ndarray, list]:
    ids = row.column(f"{prefix}ids")[i].values
    flat = row.column(f"{prefix}flat")[i].values.to_numpy(zero_copy_only=False)
    bias = row.column(f"{prefix}bias")[i].values.to_numpy(zero_copy_only=False)
    return flat.reshape(len(ids), -1), bias, ids


def _ordered_sums(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``v @ u``, added up in the order of the components, as ``dot`` does."""
    return np.cumsum(v * u, axis=1)[:, -1] if len(u) else np.zeros(len(v))


def _below(u: np.ndarray, v: np.ndarray, v_bias: np.ndarray, wanted: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each (row of ``u``, its scores): how many of the row's scores of the items are less, and how many at most, each of them.

    One matrix product decides for all items but those whose score is within rounding of a wanted one; these few are added
    up in the order of the components, as all are if a number is not finite.
    """
    with np.errstate(all="ignore"):
        rough = u @ v.T + v_bias
        longest = np.sqrt((v * v).sum(1).max(initial=0)), np.abs(v_bias).max(initial=0)
        # rounding is at most n + 1 units of the sum of the products' sizes, either way of adding up
        slack = 4 * (u.shape[1] + 2) * np.finfo(float).eps * (np.sqrt((u * u).sum(1)) * longest[0] + longest[1]) + 1e-290
    ordered = np.sort(rough, axis=1)
    for r, part in wanted:
        if not (np.isfinite(slack[r]) and np.isfinite(part).all() and slack[r] < 1e290):
            exact = np.sort(_ordered_sums(u[r], v) + v_bias)
            yield np.searchsorted(exact, part, "left"), np.searchsorted(exact, part, "right")
            continue
        low, high = np.searchsorted(ordered[r], part - slack[r], "left"), np.searchsorted(ordered[r], part + slack[r], "right")
        less, upto = low.copy(), low.copy()
        for n in np.flatnonzero(high > low):
            near = np.flatnonzero((rough[r] >= part[n] - slack[r]) & (rough[r] <= part[n] + slack[r]))
            exact = _ordered_sums(u[r], v[near]) + v_bias[near]
            less[n] += (exact < part[n]).sum()
            upto[n] += (exact <= part[n]).sum()
        yield less, upto


def _positions(ids: pa.Array, wanted: pa.Array) -> np.ndarray:
    """Position of each wanted id in ``ids``."""
    import pyarrow.compute as pc

    return pc.index_in(wanted, value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)


def top_items(users: DataFrame, items: DataFrame, k: int = 10, exclude: DataFrame | None = None,
              user_col: str = "userID", item_col: str = "artistID") -> DataFrame:
    """(user, item, score, rank): the k best items per user by factors and item bias.

    ``exclude`` lists (user, item) pairs that may not be recommended.  Equal
    scores are ordered by item.
    """
    users = materialise(_with_bias(users, user_col), "score-users")  # counted, then packed
    items = materialise(_with_bias(items, item_col), "score-items")
    if items.count() > BOUNDED_FROM and (dealt := _by_reach(users, items, item_col)) is not None:
        leading = materialise(dealt.orderBy(F.desc("reach"), item_col).limit(ITEM_BLOCK).select(*items.columns), "score-leading")
        users = _least_scores(users, _scored(users, leading, k, exclude, user_col, item_col), k, user_col, item_col)
        items = dealt
    scored = _scored(users, items, k, exclude, user_col, item_col)
    return ranking.first_rows(scored, [user_col], [F.desc("score"), F.asc(item_col)], k, rank_col="rank")


def _least_scores(users: DataFrame, found: DataFrame, k: int, user_col: str, item_col: str) -> DataFrame:
    """``users`` with their length and the k-th best score of those found, which the list's last will not be below."""
    kth = ranking.first_rows(found, [user_col], [F.desc("score"), F.asc(item_col)], k, rank_col="rank").where(F.col("rank") == k)
    least = users.join(kth.select(user_col, F.col("score").alias("least")), user_col, "left")
    return materialise(least.withColumns({"least": F.coalesce("least", F.lit(float("-inf"))), "length": _length()}), "score-least")


def _scored(users: DataFrame, items: DataFrame, k: int, exclude: DataFrame | None, user_col: str, item_col: str) -> DataFrame:
    """(user, item, score): of every block pair the k best items per user."""
    pairs = _block_pairs(users, items, user_col, item_col)
    user_type, item_type = users.schema[user_col].dataType, items.schema[item_col].dataType
    barring = exclude is not None
    if barring:
        n_u, n_i = users.count(), items.count()
        ublock = F.pmod(F.xxhash64(user_col), F.lit(max(1, -(-n_u // USER_BLOCK)))).cast("int")
        iblock = F.pmod(F.xxhash64(item_col), F.lit(max(1, -(-n_i // ITEM_BLOCK)))).cast("int")
        exclude = exclude.select(F.col(user_col).cast(user_type), F.col(item_col).cast(item_type)).distinct()
        if "iblock" in items.columns:
            exclude, iblock = exclude.join(items.select(item_col, "iblock").distinct(), item_col), F.col("iblock")
        # at most one block pair's cells per group
        barred = (
            exclude
            .groupBy(ublock.alias("ublock"), iblock.alias("iblock"))
            .agg(F.collect_list(F.struct(F.col(user_col).alias("u"), F.col(item_col).alias("i"))).alias("cells"))
            .select("ublock", "iblock", F.transform("cells", lambda c: c["u"]).alias("xu"),
                    F.transform("cells", lambda c: c["i"]).alias("xi"))
        )
        pairs = pairs.join(barred, ["ublock", "iblock"], "left")
    schema = T.StructType([T.StructField(user_col, user_type), T.StructField(item_col, item_type),
                           T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                u, u_bias, u_ids = _matrix(batch, i, "u")
                v, v_bias, v_ids = _matrix(batch, i, "i")
                order = np.argsort(np.asarray(v_ids.to_pylist()), kind="stable")
                scores = u @ v[order].T + v_bias[order] + u_bias[:, None]
                if barring and batch.column("xu")[i].is_valid:
                    place = np.argsort(order)
                    rows = _positions(u_ids, batch.column("xu")[i].values)
                    cols = _positions(v_ids, batch.column("xi")[i].values)
                    known = (rows >= 0) & (cols >= 0)
                    scores[rows[known], place[cols[known]]] = -np.inf
                size = min(k, scores.shape[1])
                edge = np.partition(scores, scores.shape[1] - size, axis=1)[:, -size]
                row, col = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
                value = scores[row, col]
                best = np.lexsort((col, -value, row))
                best = best[np.arange(len(row)) - np.searchsorted(row, row) < size]
                yield pa.RecordBatch.from_arrays(
                    [u_ids.take(pa.array(row[best])), v_ids.take(pa.array(order[col[best]])), pa.array(value[best])],
                    names=[user_col, item_col, "score"])

    return pairs.mapInArrow(score, schema)


def user_auc(users: DataFrame, items: DataFrame, truth: DataFrame, user_col: str = "userID",
             item_col: str = "artistID") -> DataFrame:
    """(user, auc) over all items for users with positives; ties count half.

    Each block pair only returns, per user, how many of its items score below
    the user's positives; positives among themselves always contribute P * P / 2.
    Scores are compared as they are, at any size: wherever rounding could decide, both sides add the
    products in the order of the components, so one pair has the same bits on both.  A user's
    own bias moves all of the user's scores alike and is left out.
    """
    known = _with_bias(users, user_col).withColumnsRenamed({"factors": "uf", "bias": "ub"})
    listed = _with_bias(items, item_col).withColumnsRenamed({"factors": "vf", "bias": "vb"})
    value = dot("uf", "vf") + F.col("vb")
    positives = truth.select(user_col, item_col).distinct().join(known, user_col).join(listed, item_col)
    positives = materialise(positives.select(user_col, item_col, value.alias("score")), "positives")
    counts = positives.groupBy(user_col).agg(F.count("*").alias("p"))
    # a user with very many positives is cut into parts; the sums below add up over them
    part = F.pmod(F.xxhash64(item_col), F.ceil(F.col("p") / F.lit(POSITIVES))).cast("int")
    hits = positives.join(counts, user_col).groupBy(user_col, part.alias("part")).agg(F.collect_list("score").alias("scores"))

    wanted = materialise(_with_bias(users.join(counts.select(user_col), user_col, "left_semi"), user_col), "score-users")
    items = materialise(_with_bias(items, item_col), "score-items")
    pairs = _block_pairs(wanted, items, user_col, item_col)
    n_users = max(1, -(-wanted.count() // USER_BLOCK))
    block = F.pmod(F.xxhash64(user_col), F.lit(n_users)).cast("int")
    packed = hits.groupBy(block.alias("ublock"), "part").agg(F.collect_list(F.struct(F.col(user_col).alias("u"), "scores")).alias("p"))
    packed = packed.select("ublock", F.transform("p", lambda r: r["u"]).alias("pu"),
                           F.transform("p", lambda r: F.size(r["scores"])).alias("pn"),
                           F.flatten(F.transform("p", lambda r: r["scores"])).alias("ps"))
    user_type = users.schema[user_col].dataType
    schema = T.StructType([T.StructField(user_col, user_type), T.StructField("below", T.DoubleType())])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                u, _, u_ids = _matrix(batch, i, "u")
                v, v_bias, _ = _matrix(batch, i, "i")
                rows = _positions(u_ids, batch.column("pu")[i].values)
                ends = np.cumsum(batch.column("pn")[i].values.to_numpy(zero_copy_only=False))
                flat = batch.column("ps")[i].values.to_numpy(zero_copy_only=False)
                totals = np.zeros(len(rows))
                for n, (less, upto) in enumerate(_below(u, v, v_bias, list(zip(rows, np.split(flat, ends[:-1]))))):
                    totals[n] = (less + upto).sum() / 2.0
                yield pa.RecordBatch.from_arrays([batch.column("pu")[i].values, pa.array(totals)], names=[user_col, "below"])

    sums = pairs.join(packed, "ublock").mapInArrow(below, schema).groupBy(user_col).agg(F.sum("below").alias("below"))
    sizes = counts.select(user_col, F.col("p").cast("double").alias("p"))
    total = items.agg(F.count("*").cast("double")).scalar()
    area = F.try_divide(F.col("below") - F.col("p") * F.col("p") / 2, F.col("p") * (total - F.col("p")))
    return sums.join(sizes, user_col).select(user_col, area.alias("auc"))


def survey_weights(ratings: DataFrame, survey: DataFrame | None = None, user_col: str = "user_id",
                   item_col: str = "artist_id", rank_col: str = "rank") -> DataFrame:
    """(user, item, weight): one weight per rated survey artist; the best rank counts."""
    if survey is not None:
        ratings = ratings.join(survey.select(F.col(item_col)), item_col, "left_semi")
    best = ratings.groupBy(user_col, item_col).agg(F.min(rank_col).alias(rank_col))
    return best.select(user_col, item_col, rank_weight(rank_col).alias("weight"))


def survey_vectors(weights: DataFrame, items: DataFrame, user_col: str = "user_id", item_col: str = "artist_id",
                   factor_key: str = "artistID") -> DataFrame:
    """(user, factors): weighted average of the item factors of each user's preferences.

    A survey lists at most ten artists, so the rows collected per user are few.
    """
    liked = weights.filter(F.col("weight") > 0).join(
        items.select(F.col(factor_key).alias(item_col), "factors"), item_col)
    rows = liked.groupBy(user_col).agg(
        F.array_sort(F.collect_list(F.struct(item_col, "weight", F.col("factors").cast("array<double>").alias("factors")))).alias("rows"),
        F.sum("weight").alias("total"),
    )
    zero = F.transform(F.get("rows", F.lit(0))["factors"], lambda x: F.lit(0.0))
    summed = F.aggregate("rows", zero, lambda acc, r: F.zip_with(acc, r["factors"], lambda a, x: a + r["weight"] * x))
    return rows.select(user_col, F.transform(summed, lambda x: x / F.col("total")).alias("factors"))


class RecommendationService:
    """Recommendations for users known only by a ranked survey, for all waiting users at once."""

    def __init__(self, items: DataFrame, names: DataFrame, survey: DataFrame):
        self.items = items
        self.names = names
        self.survey = survey

    def create_user_vector_from_survey(self, ratings: DataFrame) -> DataFrame:
        return survey_vectors(survey_weights(ratings, self.survey), self.items)

    def get_recommendations(self, user_vectors: DataFrame, k: int = 3, exclude_survey_artists: bool = True) -> DataFrame:
        """(user_id, rank, artistID, artist_name, score)."""
        pool = self.items
        if exclude_survey_artists:
            pool = pool.join(self.survey.select(F.col("artist_id").alias("artistID")), "artistID", "left_anti")
        best = top_items(user_vectors, pool, k, user_col="user_id")
        return lookup_name(best, self.names).select("user_id", "rank", "artistID", "artist_name", "score")

    def recommend_from_survey(self, survey_responses: DataFrame, k: int = 3) -> DataFrame:
        """(user_id, artist_id, rank) rows to recommendations; an input without any preference is an error."""
        vectors = self.create_user_vector_from_survey(survey_responses)
        if vectors.isEmpty():
            raise ValueError("User vector has no preferences!")
        return self.get_recommendations(vectors, k)
