"""Exact percentiles (linear interpolation) of columns, per group or overall.

The built-in ``percentile`` keeps the distinct values of a group in one
buffer, which is right for groups up to ``limit`` values.  Larger groups are
narrowed instead: a mergeable sketch proposes an interval around the wanted
rank, one count verifies it, and the next round looks only inside it, until
few enough values are left to rank exactly.  No round moves raw rows.

Without groups the wanted ranks of all columns are narrowed side by side: a
round is one aggregate over the table as it stands, which counts the present
intervals and sketches what is inside them.  Only such numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harmonium.session import materialise

#: values one aggregation buffer may hold
BUFFER_VALUES = 1_000_000
#: state rows that may be broadcast (checked by a count)
BROADCAST_ROWS = 100_000

_GRID = 1000
#: steps of a sketch in the side-by-side rounds, and values a rank is finally found among
_STEPS, _FINAL = 500, 20_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0


def percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                limit: int = BUFFER_VALUES) -> DataFrame:
    """(*by, column, prob, value): exact percentiles of the non-null values."""
    by = list(by)
    numbers = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    if largest_group(numbers, by) <= limit:
        return _built_in(numbers, columns, probs, by)
    if not by:
        return _side_by_side(numbers, columns, probs, limit)
    values = numbers.unpivot(by, list(columns), "column", "value").filter(F.col("value").isNotNull())
    return _narrowed(values, [*by, "column"], probs, limit)


def _built_in(numbers: DataFrame, columns: Sequence[str], probs: Sequence[float], by: list[str]) -> DataFrame:
    grid = F.array(*[F.lit(float(p)) for p in probs])
    wide = numbers.groupBy(*by).agg(*[F.percentile(c, grid).alias(c) for c in columns])
    tall = wide.unpivot(by, list(columns), "column", "values")
    return tall.filter(F.col("values").isNotNull()).select(
        *by, "column", F.inline(F.arrays_zip(grid.alias("prob"), F.col("values").alias("value")))
    ).toDF(*by, "column", "prob", "value")


@dataclass
class _Rank:
    """The k-th smallest value (from 0) of a column: it is within [lo, hi], between ``below`` smaller values."""

    column: str
    k: int
    lo: float
    hi: float
    steps: list[float] | None = None  # sketch of the values inside
    below: int = 0
    inside: int = 0
    margin: int = 1
    value: float | None = None

    def proposal(self) -> tuple[float, float]:
        """A narrower interval that should hold the rank, from the sketch."""
        if not self.steps:
            return self.lo, self.hi
        place = (self.k - self.below) / max(1, self.inside) * _STEPS
        left, right = math.floor(place) - self.margin, math.ceil(place) + self.margin
        return self.lo if left <= 0 else self.steps[left], self.hi if right >= _STEPS else self.steps[right]


def _side_by_side(numbers: DataFrame, columns: Sequence[str], probs: Sequence[float], limit: int) -> DataFrame:
    steps = F.array(*[F.lit(i / _STEPS) for i in range(_STEPS + 1)])
    sketch = lambda c: F.percentile_approx(c, steps, 10 * _STEPS)
    final = max(1, min(limit, _FINAL))
    makers = [lambda c: F.count(c), lambda c: F.min(c), lambda c: F.max(c), sketch]
    row = iter(numbers.agg(*[m(F.col(f"`{c}`")).alias(f"a{i}_{j}") for i, c in enumerate(columns) for j, m in enumerate(makers)]).first())
    sizes, ranks = {}, {}
    for c in columns:
        n, lo, hi, cuts = next(row), next(row), next(row), next(row)
        if n:
            sizes[c] = n
            for k in {f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)}:
                ranks[c, k] = _Rank(c, k, lo, hi, cuts, 0, n)
    while open_ranks := [r for r in ranks.values() if r.value is None]:
        aggregates, tried = [], []
        for i, r in enumerate(open_ranks):
            v = F.col(f"`{r.column}`")
            if r.inside <= final and r.steps is None:  # counted: what is inside is sorted as it is
                held = F.when((v > r.lo) & (v < r.hi), v)
                aggregates.append(F.get(F.array_sort(F.collect_list(held)), F.lit(r.k - r.below)).alias(f"v{i}"))
                tried.append(None)
                continue
            lo, hi = r.proposal()
            inner = (v > lo) & (v < hi)
            tried.append((lo, hi))
            aggregates.append(F.struct(F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if(inner).alias("inside"),
                                       F.count_if((v == hi) & F.lit(hi > lo)).alias("at_hi"), sketch(F.when(inner, v)).alias("steps")).alias(f"v{i}"))
        for r, bounds, got in zip(open_ranks, tried, numbers.agg(*aggregates).first(), strict=True):
            if bounds is None:
                r.value = got
                continue
            lo, hi = bounds
            if got["below"] <= r.k < got["below"] + got["at_lo"]:
                r.value = lo
            elif got["below"] + got["at_lo"] <= r.k < got["below"] + got["at_lo"] + got["inside"]:
                r.lo, r.hi, r.below, r.inside, r.margin = lo, hi, got["below"] + got["at_lo"], got["inside"], 1
                r.steps = got["steps"] if r.inside > final else None
            elif r.k < got["below"] or r.k >= got["below"] + got["at_lo"] + got["inside"] + got["at_hi"]:
                r.margin *= 4  # the sketch was off by more; try a wider interval
            else:
                r.value = hi
    out = []
    for c, n in sizes.items():
        for p in dict.fromkeys(probs):
            place = p * (n - 1)
            low, high = ranks[c, math.floor(place)].value, ranks[c, math.ceil(place)].value
            out.append((c, float(p), low + (high - low) * (place - math.floor(place)) if high != low else low))
    return numbers.sparkSession.createDataFrame(out, "column STRING, prob DOUBLE, value DOUBLE")


def _narrowed(values: DataFrame, keys: list[str], probs: Sequence[float], limit: int) -> DataFrame:
    sizes = materialise(
        values.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("value").alias("__lo"), F.max("value").alias("__hi")),
        "percentile-sizes",
    )
    grid = F.array(*[F.lit(float(p)) for p in probs])
    small = _with_state(values, sizes.filter(F.col("__n") <= limit).select(*keys), keys)
    quick = small.groupBy(*keys).agg(F.percentile("value", grid).alias("values"))
    quick = quick.select(*keys, F.inline(F.arrays_zip(grid.alias("prob"), F.col("values").alias("value")))).toDF(
        *keys, "prob", "value")

    wanted = sizes.filter(F.col("__n") > limit).withColumn("prob", F.explode(grid))
    place = F.col("prob") * (F.col("__n") - 1)
    wanted = wanted.withColumns({
        "__k0": F.floor(place).cast("bigint"), "__k1": F.ceil(place).cast("bigint"), "__part": place - F.floor(place),
    })
    ranks = wanted.select(*keys, "__lo", "__hi", F.explode(F.array("__k0", "__k1")).alias("__k")).distinct()
    chosen = _rank_values(values, ranks, keys, limit)

    first = chosen.withColumnsRenamed({"__k": "__k0", "value": "__v0"})
    second = chosen.withColumnsRenamed({"__k": "__k1", "value": "__v1"})
    slow = wanted.join(first, [*keys, "__k0"]).join(second, [*keys, "__k1"]).select(
        *keys, "prob", (F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.col("__part")).alias("value")
    )
    return quick.unionByName(slow)


def _with_state(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Values joined to the per-group state; broadcast only when the state is counted small."""
    if state.count() <= BROADCAST_ROWS:
        state = F.broadcast(state)
    return values.join(state, keys)


def _rank_values(values: DataFrame, ranks: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, k, value): the k-th smallest value (from 0) of each group."""
    target = [*keys, "__k"]
    state = materialise(_counted(values, ranks, keys), "percentile-state")
    grid = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])
    margin = 1
    while True:
        unsettled = state.filter(_between_bounds() & (F.col("__inside") > limit))
        if unsettled.isEmpty():
            break
        inner = _with_state(values, unsettled, keys).filter((F.col("value") > F.col("__lo")) & (F.col("value") < F.col("__hi")))
        sketch = inner.groupBy(*target).agg(F.percentile_approx("value", grid, 10 * _GRID).alias("__cuts"))
        share = (F.col("__k") - F.col("__below") - F.col("__at_lo")) / F.col("__inside") * _GRID
        left = F.floor(share).cast("int") - margin
        right = F.ceil(share).cast("int") + margin
        proposal = unsettled.join(sketch, target).select(
            *target,
            F.when(left <= 0, F.col("__lo")).otherwise(F.get("__cuts", left)).alias("__lo"),
            F.when(right >= _GRID, F.col("__hi")).otherwise(F.get("__cuts", right)).alias("__hi"),
        )
        tried = materialise(_counted(values, proposal, keys), "percentile-try")
        holds = (F.col("__k") >= F.col("__below")) & (F.col("__k") < F.col("__below") + F.col("__at_lo") + F.col("__inside") + F.col("__at_hi"))
        good = tried.filter(holds)
        if good.isEmpty():
            margin *= 2
            continue
        state = materialise(state.join(good.select(*target), target, "left_anti").unionByName(good), "percentile-state")

    at_low = F.col("__k") < F.col("__below") + F.col("__at_lo")
    edge = state.filter(~_between_bounds()).select(*target, F.when(at_low, F.col("__lo")).otherwise(F.col("__hi")).alias("value"))
    last = state.filter(_between_bounds()).withColumn("__r", F.col("__k") - F.col("__below") - F.col("__at_lo"))
    inner = _with_state(values, last.select(*target, "__r", "__lo", "__hi"), keys)
    inner = inner.filter((F.col("value") > F.col("__lo")) & (F.col("value") < F.col("__hi")))
    counts = inner.groupBy(*target, "__r", "value").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*target).orderBy("value"))
    inside = counts.withColumn("__upto", upto).filter((F.col("__r") < F.col("__upto")) & (F.col("__r") >= F.col("__upto") - F.col("__n")))
    return edge.unionByName(inside.select(*target, "value"))


def _between_bounds():
    """The wanted rank lies strictly between the bounds, not at one of them."""
    start = F.col("__below") + F.col("__at_lo")
    return (F.col("__k") >= start) & (F.col("__k") < start + F.col("__inside"))


def _counted(values: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds with the number of values below, at, inside and at the upper bound."""
    v, lo, hi = F.col("value"), F.col("__lo"), F.col("__hi")
    return _with_state(values, bounds, keys).groupBy(*keys, "__k", "__lo", "__hi").agg(
        F.count_if(v < lo).alias("__below"),
        F.count_if(v == lo).alias("__at_lo"),
        F.count_if((v > lo) & (v < hi)).alias("__inside"),
        F.count_if((v == hi) & (hi > lo)).alias("__at_hi"),
    )
