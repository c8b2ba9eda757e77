"""Exact duplicates by a sort of contents (operator 11).

Texts are normalised and ordered by their leading characters, then by digest, then by all their bytes, then by descending
id.  Spark samples that order for splitters and deals the rows into ranges; each range is sorted externally, so equal
texts lie next to each other and one pass compares every text in full with the one before it.  The id is part of the order
that is split, therefore a text that a third of all rows share fills as many ranges as its rows need.  Splitters hold
``LEAD`` characters and a digest, never whole texts, so what the driver sees of them is bounded however long texts are.

Only the first and the last run of a range can go on in another range.  Those (two texts a range) are compared in full with
their neighbour's and joined to chains; numbers of ranges, never texts, pass through the driver for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonium.llm.common import bounded_batches, broadcast_if_small, materialise, read

#: Leading characters of a text that are part of the splitters.
LEAD = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: ``run``: 0 inside a range, 1 its first run, 2 its last, 3 both.  ``border`` is the text of those.
_RUNS = pa.schema([("id", pa.int64()), ("digest", pa.string()), ("keep", pa.int64()), ("size", pa.int64()), ("kept", pa.bool_()),
                   ("part", pa.int32()), ("run", pa.int8()), ("border", pa.string())])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted range; a run's ids (not its texts) are held until it ends."""
    part = TaskContext.get().partitionId()
    held: list[np.ndarray] = []  # ids of the open run, a null id is masked
    holes: list[np.ndarray] = []
    text = digest = None
    first = True

    def rows(ids, null, digests, keeps, sizes, kept, run=0, text=None) -> pa.RecordBatch:
        n = len(ids)
        columns = [pa.array(ids, mask=null), digests, keeps, pa.array(sizes), pa.array(kept), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, run, np.int8)),
                   pa.array([text] + [None] * (n - 1), pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=_RUNS)

    def close(last: bool) -> pa.RecordBatch:
        nonlocal first
        ids, null = np.concatenate(held), np.concatenate(holes)
        n, run = len(ids), int(first) + 2 * int(last)
        first = False
        keep = None if null[0] else int(ids[0])  # ids descend, nulls come last
        return rows(ids, null, pa.array([digest] * n, pa.string()), pa.array([keep] * n, pa.int64()), np.full(n, n), np.arange(n) == 0, run, text if run else None)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, ids, digests = batch.column("norm"), batch.column("id"), batch.column("digest")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy()
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        new[0] = text is None or texts[0].as_py() != text
        starts = np.flatnonzero(new)
        if new[0]:
            if held:
                yield close(False)
            held, holes, text, digest = [], [], texts[0].as_py(), digests[0].as_py()
            starts = starts[1:]
        end = starts[0] if len(starts) else n
        held.append(numbers[:end]), holes.append(null[:end])
        if len(starts):
            yield close(False)
            last = starts[-1]
            if last > end:  # runs that begin and end in this batch
                sizes = np.diff(starts)
                heads = np.repeat(starts[:-1], sizes)
                inner = slice(end, last)
                yield rows(numbers[inner], null[inner], digests.slice(end, last - end), pa.array(numbers[heads], mask=null[heads]), np.repeat(sizes, sizes), new[inner])
            held, holes, text, digest = [numbers[last:]], [null[last:]], texts[int(last)].as_py(), digests[int(last)].as_py()
    if held:
        yield close(True)


class ContentSort:
    """``transform(table)``: one row per row of ``table``, with keep, size, kept and digest.

    ``id_col`` is a whole number.  Equal texts (after ``normalise``; null counts as empty) form a group; its row with the
    largest id stays (smallest with ``keep_largest=False``).  Of repeated rows with that id one stays, which one is not
    told apart; a null id stays only if the group has no other.  An empty table gives an empty table.  Other columns are
    not read, so their names cannot clash; ``deduplicated(table)`` returns the staying rows' ids.
    """

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", keep_largest: bool = True, normalise: Callable[[Column], Column] = lower_ascii):
        self.id_col, self.text_col, self.keep_largest, self.normalise = id_col, text_col, keep_largest, normalise

    def transform(self, table: DataFrame) -> DataFrame:
        """(id, keep, size, kept, digest)."""
        sign = 1 if self.keep_largest else -1
        rows = table.select((F.col(self.id_col).cast("long") * sign).alias("id"), self.normalise(F.col(self.text_col)).alias("norm"))
        rows = rows.select("id", "norm", F.sha2(F.encode("norm", "UTF-8"), 256).alias("digest"), F.substring("norm", 1, LEAD).alias("lead"))
        order = ["lead", "digest", "norm", F.desc_nulls_last("id")]
        dealt = rows.repartitionByRange("lead", "digest", F.desc_nulls_last("id")).sortWithinPartitions(*order)
        with bounded_batches(table.sparkSession):
            found = materialise(dealt.select("id", "norm", "digest").mapInArrow(runs, "id long, digest string, keep long, size long, kept boolean, part int, run byte, border string"), "runs")
        chains = self._chains(found)
        joined = found.drop("border").join(broadcast_if_small(chains), ["part", "run"], "left")
        is_first = F.col("at").isNull() | ((F.col("part") == F.col("first_part")) & (F.col("run") == F.col("first_run")))
        return joined.select(
            (F.col("id") * sign).alias("id"), (F.when(F.col("at").isNotNull(), F.col("chain_keep")).otherwise(F.col("keep")) * sign).alias("keep"),
            F.coalesce("chain_size", "size").alias("size"), (F.col("kept") & is_first).alias("kept"), "digest")

    def _chains(self, found: DataFrame) -> DataFrame:
        """For each border run (part, run): the chain of equal border runs it belongs to, with its size and kept id."""
        border = materialise(found.where("border is not null").select("part", "run", "border", "keep", "size"), "borders")
        places = sorted((r["part"], r["run"]) for r in border.select("part", "run").collect())  # two a range
        spark = found.sparkSession
        after = spark.createDataFrame([(*b, *a) for a, b in zip(places, places[1:])], "part int, run int, before_part int, before_run int")
        mine = border.select(F.col("part"), F.col("run").cast("int").alias("run"), "border")
        before = mine.toDF("before_part", "before_run", "before")
        same = {(r["part"], r["run"]) for r in after.join(mine, ["part", "run"]).join(before, ["before_part", "before_run"]).where("border = before").select("part", "run").collect()}
        rows, at = [], -1
        for place in places:
            at += place not in same
            rows.append((*place, at))
        chained = spark.createDataFrame(rows, "part int, run int, at long").select("part", F.col("run").cast("byte").alias("run"), "at")
        linked = border.drop("border").join(chained, ["part", "run"])
        ends = linked.groupBy("at").agg(F.min_by(F.struct("part", "run", "keep"), F.struct("part", "run")).alias("first"), F.sum("size").alias("chain_size"))
        return chained.join(ends, "at").select("part", "run", "at", F.col("first.part").alias("first_part"), F.col("first.run").alias("first_run"), F.col("first.keep").alias("chain_keep"), "chain_size")

    def deduplicated(self, table: DataFrame) -> DataFrame:
        """The ids of the rows that stay."""
        return self.transform(table).where("kept").select(F.col("id").alias(self.id_col))


def op11_content_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of ``documents`` with the row of its group that stays; see ``ContentSort`` for odd rows."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return ContentSort().transform(docs).select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


OP11_SQL = f"""WITH n AS (SELECT doc_id, TRANSLATE(COALESCE(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, MAX(doc_id) OVER (PARTITION BY norm) AS keep_id, COUNT(*) OVER (PARTITION BY norm) AS group_size,
  ROW_NUMBER() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, SHA256(norm) AS text_sha256 FROM n"""
