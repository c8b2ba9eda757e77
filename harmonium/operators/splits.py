"""Train/test/validation splits with exact part sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmonium.operators import ranking
from harmonium.session import fine_partitions, materialise

PART = "split"

#: copies of one row that a single task writes out
COPY_CHUNK = 65_536


def repeat_rows(df: DataFrame, count_col: str, largest: int, chunk: int = COPY_CHUNK) -> DataFrame:
    """Each row ``count_col`` times; long runs of copies are spread over tasks."""
    if largest <= 1:
        return df.filter(F.col(count_col) > 0).drop(count_col)
    if largest > chunk:
        steps = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count_col) - 1) / F.lit(chunk)))
        df = (
            df.filter(F.col(count_col) > 0)
            .withColumn("__step", F.explode(steps))
            .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            .withColumn(count_col, F.least(F.lit(chunk), F.col(count_col) - F.col("__step") * chunk))
            .drop("__step")
        )
    copies = F.array_repeat(F.lit(0), F.col(count_col).cast("int"))
    return df.withColumn("__copy", F.explode(copies)).drop("__copy", count_col)


def part_sizes(total: Column, test_size: float, val_size: float) -> tuple[Column, Column]:
    """Rows of the test and validation parts out of ``total``; train takes the rest.

    A part that would leave no training row is not taken.
    """
    ratio = float(val_size / (1 - test_size))
    test = F.ceil(total * F.lit(float(test_size))).cast("bigint")
    test = F.when(test >= total, F.lit(0)).otherwise(test).cast("bigint")
    rest = total - test
    val = F.ceil(rest * F.lit(ratio)).cast("bigint")
    val = F.when((val >= rest) | (test == 0), F.lit(0)).otherwise(val).cast("bigint")
    return test, val


def assign_split(df: DataFrame, strategy: str = "random", test_size: float = 0.2, val_size: float = 0.1,
                 random_state: int = 42, user_col: str = "userID", item_col: str = "artistID",
                 min_rows: int = 3, slice_rows: int = ranking.SLICE_ROWS, copy_chunk: int = COPY_CHUNK) -> DataFrame:
    """``df`` with a ``split`` column of train, test or val.

    Rows are dealt in the order of an md5 digest: the first go to test, the
    next to val, the rest to train; per user for ``user_stratified``, where
    users with fewer than ``min_rows`` rows stay in train.  Equal rows are
    counted first, so copies never crowd one task.  The result is written once, in tasks of bounded size.
    """
    if strategy not in ("random", "user_stratified"):
        raise ValueError(f"Unknown split strategy: {strategy}")
    with fine_partitions(df.sparkSession):
        return materialise(_dealt(df, strategy, test_size, val_size, random_state, user_col, item_col, min_rows, slice_rows, copy_chunk), "split")


def _dealt(df: DataFrame, strategy: str, test_size: float, val_size: float, random_state: int, user_col: str, item_col: str,
           min_rows: int, slice_rows: int, copy_chunk: int) -> DataFrame:
    keys = [user_col] if strategy == "user_stratified" else []
    named = [c for c in (user_col, item_col) if c in df.columns] or df.columns
    others = [c for c in df.columns if c not in named]

    rows = materialise(df.groupBy(*df.columns).agg(F.count("*").alias("__copies")), "split-rows")
    rows = rows.withColumn("__digest", ranking.digest(*named, seed=random_state))
    sizes = rows.groupBy(*keys).agg(F.sum("__copies").alias("size"), F.max("__copies").alias("copies"))
    largest = sizes.agg(F.max("size").alias("size"), F.max("copies").alias("copies")).first()

    ranked = ranking.positions(rows, keys, "__digest", [*named, *others], weight_col="__copies", start_col="__start",
                               total_col="__total", largest=largest["size"] or 0, slice_rows=slice_rows)
    test, val = part_sizes(F.col("__total"), test_size, val_size)
    if keys:
        enough = F.col("__total") >= min_rows
        test, val = F.when(enough, test).otherwise(F.lit(0)), F.when(enough, val).otherwise(F.lit(0))
    ranked = ranked.withColumns({"__test": test.cast("bigint"), "__val": val.cast("bigint")})
    start, end = F.col("__start"), F.col("__start") + F.col("__copies")
    if (largest["copies"] or 0) <= 1:
        part = F.when(start < F.col("__test"), "test").when(start < F.col("__test") + F.col("__val"), "val")
        return ranked.withColumn(PART, part.otherwise("train")).select(*df.columns, PART)

    def inside(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, high) - F.greatest(start, low))

    first, second = F.col("__test"), F.col("__test") + F.col("__val")
    parts = F.array(
        F.struct(F.lit("test").alias(PART), inside(F.lit(0), first).alias("__n")),
        F.struct(F.lit("val").alias(PART), inside(first, second).alias("__n")),
        F.struct(F.lit("train").alias(PART), inside(second, F.col("__total")).alias("__n")),
    )
    dealt = ranked.select(*df.columns, F.inline(F.filter(parts, lambda p: p["__n"] > 0)))
    return repeat_rows(dealt, "__n", largest["copies"], copy_chunk)


def user_stratified_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.1, random_state: int = 42,
                          **options) -> DataFrame:
    return assign_split(df, "user_stratified", test_size, val_size, random_state, **options)


def random_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.1, random_state: int = 42,
                 **options) -> DataFrame:
    return assign_split(df, "random", test_size, val_size, random_state, **options)


def in_part(df: DataFrame, part: str, keep: Sequence[str] | None = None) -> DataFrame:
    rows = df.filter(F.col(PART) == part)
    return rows.select(*keep) if keep else rows.drop(PART)
