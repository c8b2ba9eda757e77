"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmonium.llm.common import discard, materialise

#: Up to so many edges (16 bytes each), a round is one task without a shuffle.
FEW_EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the smallest node reached.

    Alternates "large star" and "small star" steps: every node points its neighbours to the smallest one it knows.  Each
    step is one grouped minimum and one join, and the number of edges never grows, so a hub costs no more than its
    edges.  Ends when a round changes nothing.  Null ends and loops are ignored; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    current = materialise(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = _sign(current)
    while seen[0]:
        if seen[0] <= FEW_EDGES:
            current = current.coalesce(1)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        before, current = current, materialise(small.where("a <> b").distinct(), "edges")
        discard(before)
        now = _sign(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct() if seen[0] else spark.createDataFrame([], roots.schema)


def _sign(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
