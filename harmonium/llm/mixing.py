"""Interleaving sources at target weights by Pfair scheduling (operator 2, built-in functions only).

Every source is cut into blocks.  With integer shares ``p`` that sum to ``P``, the ``k``-th block of a source (from 1) is
released at slot ``floor((k - 1) P / p)`` and due by slot ``ceil(k P / p)``.  Taking the released block with the
earliest deadline in every slot meets all deadlines, so that at any slot every source is less than one block away from
its exact share.  The schedule repeats after ``P`` slots, hence it is computed for one period only, in a table whose size
depends on the shares alone; a block's slot follows from its number by one small join.

A source that has run out leaves its slots empty; the others go on at their mutual proportions and nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harmonium.llm.common import DOCUMENT_COLUMNS, broadcast_if_small, prepared, read

#: Documents of a block, and hexadecimal digits of the digest by which a source is cut into slices.
BLOCK_DOCS, SLICE_DIGITS = 16, 3
#: Share of the largest source; the others get less by the square root of their size.
LARGEST_SHARE = 100


def root_shares(docs: DataFrame) -> DataFrame:
    """(source, share): sources weigh by the square root of their number of documents, so that a hot one is tempered."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n").alias("most"))
    return sizes.join(F.broadcast(most)).select("source", F.ceil(LARGEST_SHARE * F.sqrt(F.col("n").cast("double")) / F.sqrt(F.col("most").cast("double"))).cast("long").alias("share"))


def schedule(shares: DataFrame) -> DataFrame:
    """(source, share, period, turn, slot): the slot of each source's ``turn``-th block (from 0) in one period.

    ``shares`` has one row per source with a positive whole number; sources with null or smaller shares are not
    scheduled.  Equal deadlines go to the source first in order, null before all others.
    """
    rows = shares.where("share > 0").agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", F.col("share").cast("long").alias("share")))).alias("sources"))
    rows = rows.where("size(sources) > 0").withColumn("period", F.expr("aggregate(sources, 0L, (a, x) -> a + x.share)"))
    step = """
        transform(array(array_min(filter(transform(sources, (x, i) ->
            if(state.done[i] < x.share and (state.done[i] * period) div x.share <= t,
               named_struct('due', ((state.done[i] + 1) * period + x.share - 1) div x.share, 'i', i), null)), x -> x is not null))),
          best -> named_struct('done', transform(state.done, (n, i) -> if(i = best.i, n + 1, n)),
                               'picks', concat(state.picks, array(best.i))))[0]
    """
    picks = f"aggregate(sequence(0L, period - 1), named_struct('done', transform(sources, x -> 0L), 'picks', cast(array() as array<int>)), (state, t) -> {step}).picks"
    slots = rows.select("sources", "period", F.posexplode(F.expr(picks)).alias("slot", "i"))
    # the period is as long as the shares say, whatever the number of documents
    turn = F.row_number().over(W.partitionBy("i").orderBy("slot")) - 1
    return slots.withColumn("turn", turn.cast("long")).select(F.expr("sources[i].source").alias("source"), F.expr("sources[i].share").alias("share"), "period", "turn", F.col("slot").cast("long").alias("slot"))


def mixed(docs: DataFrame, shares: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` (doc_id, source and any others) with block, place, release, deadline, slot; order by (slot, place).

    Within a source, documents come in the order of a digest of their doc_id, cut into 4,096 slices that are numbered
    on their own, so that a hot source is never one group.  A null source is a source of its own, null doc_ids come
    together, repeated rows get places one after the other.  Sources without a share are left out (by default all have
    one).  An empty table gives an empty table.
    """
    shares = root_shares(docs) if shares is None else shares
    names = ["block", "place", "release", "deadline", "slot"]
    kept = [c for c in docs.columns if c.lower() not in names]
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(*kept, digest.alias("_digest"), F.substring(digest, 1, SLICE_DIGITS).alias("_slice"), *_key("_key"))
    counts = docs.select(F.substring(digest, 1, SLICE_DIGITS).alias("_slice"), *_key("_key")).groupBy("_key", "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy("_key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("_key", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_key", "_slice").orderBy("_digest", "doc_id"))
    rows = rows.withColumn("_row", within).join(broadcast_if_small(counts), ["_key", "_slice"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    rows = rows.withColumn("block", F.expr(f"_rank div {block_docs}")).withColumn("place", F.expr(f"_rank % {block_docs}"))
    slots = schedule(shares)
    slots = slots.select(*_key("_key"), F.col("share").alias("_share"), F.col("period").alias("_period"), F.col("turn").alias("_turn"), F.col("slot").alias("_slot"))
    most = slots.groupBy("_key").agg(F.first("_share").alias("_share"))
    rows = rows.join(broadcast_if_small(most), "_key").withColumn("_turn", F.expr("block % _share"))
    rows = rows.join(broadcast_if_small(slots.drop("_share")), ["_key", "_turn"])
    return (
        rows.withColumn("release", F.expr("(block * _period) div _share"))
        .withColumn("deadline", F.expr("((block + 1) * _period + _share - 1) div _share"))
        .withColumn("slot", F.expr("(block div _share) * _period + _slot")).select(*kept, *names)
    )


def _key(name: str) -> list[Column]:
    """The source as a key that null has too."""
    return [F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias(name)]


def op2_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(read(spark, folder, "documents").select("doc_id", "source"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture; none is dropped."""
    prepared(spark)
    return mixed(docs.select(*DOCUMENT_COLUMNS)).orderBy("slot", "place", "source", "doc_id").select(*DOCUMENT_COLUMNS)


OP2_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shares AS (
  SELECT source, CAST(ceil({LARGEST_SHARE} * sqrt(CAST(n AS DOUBLE)) / sqrt(CAST((SELECT max(n) FROM sizes) AS DOUBLE))) AS BIGINT) AS share,
    row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM sizes),
spec AS (SELECT list(share ORDER BY i) AS p, CAST(sum(share) AS BIGINT) AS period, CAST(count(*) AS BIGINT) AS k FROM shares),
sched(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(generate_series(1, k), lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM spec
  UNION ALL
  SELECT t, list_transform(generate_series(1, k), lambda x: done[x] + CASE WHEN x = best THEN 1 ELSE 0 END), best FROM (
    SELECT s.t + 1 AS t, s.done, k, list_min(list_transform(list_filter(generate_series(1, k), lambda x: s.done[x] < p[x] AND (s.done[x] * period) // p[x] <= s.t + 1),
      lambda x: {{'due': ((s.done[x] + 1) * period + p[x] - 1) // p[x], 'i': x}})).i AS best
    FROM sched s, spec WHERE s.t + 1 < period)),
turns AS (SELECT pick AS i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM sched WHERE t >= 0),
ranked AS (SELECT d.doc_id, d.source, s.share, s.i, row_number() OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id) - 1 AS rank
  FROM documents d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
blocks AS (SELECT doc_id, source, share, i, rank // {BLOCK_DOCS} AS block, rank % {BLOCK_DOCS} AS place FROM ranked)
SELECT doc_id, b.source, block, place, (block * period) // share AS release, ((block + 1) * period + share - 1) // share AS deadline,
  (block // share) * period + slot AS slot
FROM blocks b JOIN turns t ON t.i = b.i AND t.turn = b.block % b.share, spec
"""
