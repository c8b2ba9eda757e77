"""Data profiling as tables: (section, column, stat, value) in place of pictures."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmonium.operators import quantiles, ranking
from harmonium.operators.cleaning import duplicate_rows, numeric_columns, string_columns



def _corr(a: str, b: str, complete: set[str]) -> Column:
    """Pearson correlation over rows where both are present; null where undefined.

    Made of covariance and deviations: the built-in ``corr`` divides by zero
    for a constant column, which is an error in ANSI mode.  The deviation of a
    column without nulls (``complete``) is one aggregate shared by all its pairs.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    if b not in complete:
        x = F.when(F.col(b).isNotNull(), x)
    if a not in complete:
        y = F.when(F.col(a).isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def without_nan(data: DataFrame) -> DataFrame:
    """Not-a-number becomes null, so that it counts as missing and nowhere else."""
    floats = [f.name for f in data.schema.fields if f.dataType.simpleString() in ("float", "double")]
    return data.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


class EDA:
    """Profile one table, optionally against a target column.  NaN counts as missing, like null."""

    def __init__(self, data: DataFrame, target_column: str | None = None, limit: int = quantiles.BUFFER_VALUES):
        self.data = data = without_nan(data)
        self.target_column = target_column
        self.limit = limit
        self.numeric = numeric_columns(data)
        self.strings = string_columns(data)
        self.spark = data.sparkSession
        self._scalar_row: dict | None = None
        self._quartile_map: dict | None = None
        self._pair_map: dict | None = None

    # -- shared passes: a handful of numbers per column, taken once ------------

    def _scalars(self) -> dict[str, float]:
        """Row count, nulls of every column and moments of the numeric ones, from one pass."""
        if self._scalar_row is None:
            makers = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
            self._scalar_row = self.data.agg(
                F.count("*").alias("rows"),
                *[F.count_if(F.col(c).isNull()).alias(f"missing:{c}") for c in self.data.columns],
                *[f(F.col(c).cast("double")).cast("double").alias(f"{n}:{c}") for c in self.numeric for n, f in makers.items()],
            ).first().asDict()
        return self._scalar_row

    def _quartiles(self) -> dict[tuple[str, float], float]:
        """(column, prob) -> exact quartile, for columns with values."""
        if self._quartile_map is None:
            rows = quantiles.percentiles(self.data, self.numeric, [0.25, 0.5, 0.75], limit=self.limit).collect() if self.numeric else []
            self._quartile_map = {(r["column"], r["prob"]): r["value"] for r in rows}
        return self._quartile_map

    def _pairs(self) -> dict[tuple[str, str], float | None]:
        """(column, later or same column) -> correlation, all pairs from one pass."""
        if self._pair_map is None:
            pairs = [(a, b) for i, a in enumerate(self.numeric) for b in self.numeric[i:]]
            missing = self._scalars()
            complete = {c for c in self.numeric if missing[f"missing:{c}"] == 0}
            row = self.data.agg(*[_corr(a, b, complete).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
            self._pair_map = {pair: row[i] for i, pair in enumerate(pairs)}
        return self._pair_map

    def _correlation(self, a: str, b: str) -> float | None:
        pairs = self._pairs()
        return pairs[a, b] if (a, b) in pairs else pairs[b, a]

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # -- one-table summaries --------------------------------------------------

    def basic_info(self) -> DataFrame:
        """(column, stat, value, text): shape, types, nulls per column and duplicate rows; '*' is the table."""
        kinds = {f.name: f.dataType.simpleString() for f in self.data.schema.fields}
        numbers = self._scalars()
        missing = {c: float(numbers[f"missing:{c}"]) for c in kinds}
        rows = [("*", "rows", float(numbers["rows"]), None), ("*", "columns", float(len(kinds)), None), ("*", "missing", sum(missing.values()), None)]
        rows += [(c, "missing", n, None) for c, n in missing.items()]
        rows += [(c, "dtype", None, k) for c, k in kinds.items()]
        rows += [("*", "dtype_count", float(list(kinds.values()).count(k)), k) for k in sorted(set(kinds.values()))]
        copies = duplicate_rows(self.data).select(
            F.lit("*").alias("column"), F.lit("duplicate_rows").alias("stat"),
            F.col("duplicate_rows").cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
        return self._table(rows, "column STRING, stat STRING, value DOUBLE, text STRING").unionByName(copies)

    def numeric_summary(self) -> DataFrame:
        """(column, stat, value): count, mean, std, min, exact quartiles and max."""
        numbers, cuts = self._scalars(), self._quartiles()
        rows = [(c, s, numbers[f"{s}:{c}"]) for c in self.numeric for s in ("count", "mean", "std", "min", "max")]
        rows += [(c, f"{round(p * 100)}%", v) for (c, p), v in cuts.items()]
        return self._table(rows, "column STRING, stat STRING, value DOUBLE")

    def correlation_matrix(self) -> DataFrame:
        """(feature_1, feature_2, correlation) for all ordered pairs; empty below two numeric columns."""
        several = self.numeric if len(self.numeric) > 1 else []
        rows = [(a, b, self._correlation(a, b)) for a in several for b in several]
        return self._table(rows, "feature_1 STRING, feature_2 STRING, correlation DOUBLE")

    def top_correlations(self, n: int = 10) -> DataFrame:
        """(feature_1, feature_2, correlation, abs_corr): strongest pairs, each once."""
        rows = [(min(a, b), max(a, b), self._correlation(a, b)) for a, b in combinations(self.numeric, 2)]
        ranked = self._table(rows, "feature_1 STRING, feature_2 STRING, correlation DOUBLE").withColumn("abs_corr", F.abs("correlation"))
        return ranking.top_rows(ranked, [F.desc_nulls_last("abs_corr"), F.asc("feature_1"), F.asc("feature_2")], n)

    def missing_values_analysis(self) -> DataFrame:
        """(column, missing, percent) of columns with nulls."""
        numbers = self._scalars()
        counts = {c: numbers[f"missing:{c}"] for c in self.data.columns}
        rows = [(c, n, n * 100.0 / numbers["rows"]) for c, n in counts.items() if n]
        return self._table(rows, "column STRING, missing BIGINT, percent DOUBLE").orderBy(F.desc("missing"), "column")

    # -- distributions --------------------------------------------------------

    def _bounds(self) -> dict[str, tuple[float, float]]:
        """Histogram ranges; a constant column gets half a unit on both sides."""
        numbers, out = self._scalars(), {}
        for c in self.numeric:
            low, high = numbers[f"min:{c}"], numbers[f"max:{c}"]
            if low is not None:
                out[c] = (low - 0.5, high + 0.5) if low == high else (low, high)
        return out

    def _binned(self, columns: list[str], bins: int) -> DataFrame:
        """(column, bin) of every value; a value on an edge belongs to the upper bin, the maximum to the last one.

        Columns become rows first, so that one short expression serves them all.
        """
        bounds = self._bounds()
        limits = self._table([(c, *bounds[c], (bounds[c][1] - bounds[c][0]) / bins) for c in columns if c in bounds],
                             "column STRING, lo DOUBLE, hi DOUBLE, step DOUBLE")
        values = self.data.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
        x, lo, step = F.col("value"), F.col("lo"), F.col("step")
        # one row per numeric column is broadcast
        placed = values.join(F.broadcast(limits), "column").withColumn(
            "at", F.least(F.floor((x - lo) / (F.col("hi") - lo) * F.lit(float(bins))), F.lit(bins - 1)))
        at = F.col("at")
        number = F.when(x < at * step + lo, at - 1).when((at < bins - 1) & (x >= (at + 1) * step + lo), at + 1).otherwise(at)
        return placed.filter(x.isNotNull()).select("column", number.cast("int").alias("bin"))

    def distribution_analysis(self, bins: int = 30) -> DataFrame:
        """(column, bin, low, high, n): equal-width histograms of the numeric columns, empty bins included."""
        bounds = self._bounds()
        edges = [(c, i, i * ((hi - lo) / bins) + lo, (i + 1) * ((hi - lo) / bins) + lo) for c, (lo, hi) in bounds.items() for i in range(bins)]
        grid = self._table(edges, "column STRING, bin INT, low DOUBLE, high DOUBLE")
        if not bounds:
            return grid.withColumn("n", F.lit(0).cast("bigint"))
        counts = self._binned(list(bounds), bins).groupBy("column", "bin").agg(F.count("*").alias("n"))
        return grid.join(counts, ["column", "bin"], "left").fillna(0, ["n"])

    def categorical_analysis(self, top: int = 15) -> DataFrame:
        """(column, value, n, rank): the most frequent values of each string column."""
        if not self.strings:
            return self.spark.createDataFrame([], "column STRING, value STRING, n BIGINT, rank INT")
        cells = self.data.select(*self.strings).unpivot([], self.strings, "column", "value").filter(F.col("value").isNotNull())
        counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
        return ranking.first_rows(counts, ["column"], [F.desc("n"), F.asc("value")], top, rank_col="rank")

    def outlier_analysis(self) -> DataFrame:
        """(column, q1, median, q3, iqr, outliers): values strictly outside 1.5 interquartile ranges."""
        q = self._quartiles()
        filled = [c for c in self.numeric if (c, 0.25) in q]
        schema = "column STRING, q1 DOUBLE, median DOUBLE, q3 DOUBLE, iqr DOUBLE, outliers BIGINT"
        if not filled:
            return self._table([], schema)
        counters = []
        for c in filled:
            q1, q3 = q[c, 0.25], q[c, 0.75]
            spread = 1.5 * (q3 - q1)
            x = F.col(c).cast("double")
            counters.append(F.count_if((x < F.lit(q1 - spread)) | (x > F.lit(q3 + spread))).alias(c))
        outside = self.data.agg(*counters).first()
        return self._table([(c, q[c, 0.25], q[c, 0.5], q[c, 0.75], q[c, 0.75] - q[c, 0.25], outside[c]) for c in filled], schema)

    def bivariate_analysis(self, max_pairs: int = 15) -> DataFrame:
        """(feature_1, feature_2, correlation) of the first column pairs in column order."""
        rows = [(a, b, self._correlation(a, b)) for a, b in list(combinations(self.numeric, 2))[:max_pairs]]
        return self._table(rows, "feature_1 STRING, feature_2 STRING, correlation DOUBLE")

    def scatter_counts(self, x: str, y: str, bins: int = 20) -> DataFrame:
        """(x_bin, y_bin, n): a scatter plot as binned counts."""
        bounds = self._bounds()

        def place(c: str) -> Column:
            low, high = bounds[c]
            v, step = F.col(c).cast("double"), F.lit((high - low) / bins)
            at = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))), F.lit(bins - 1))
            moved = F.when(v < at * step + F.lit(low), at - 1).when((at < bins - 1) & (v >= (at + 1) * step + F.lit(low)), at + 1)
            return moved.otherwise(at).cast("int")

        both = self.data.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        return both.groupBy(place(x).alias("x_bin"), place(y).alias("y_bin")).agg(F.count("*").alias("n"))

    # -- target ---------------------------------------------------------------

    def target_analysis(self, groups: int = 20) -> DataFrame:
        """(column, kind, key, value): correlation of numeric columns with the target and its mean
        for the first groups, in key order, of each string column."""
        schema = "column STRING, kind STRING, key STRING, value DOUBLE"
        target = self.target_column
        if not target or target not in self.data.columns:
            return self.spark.createDataFrame([], schema)
        numeric = [(c, "correlation", None, self._correlation(c, target)) for c in self.numeric if c != target and target in self.numeric]
        parts = [self._table(numeric, schema)]
        texts = [c for c in self.strings if c != target]
        if texts:
            cells = self.data.select(F.col(target).cast("double").alias("__target"), *texts)
            cells = cells.unpivot(["__target"], texts, "column", "key").filter(F.col("key").isNotNull())
            means = cells.groupBy("column", "key").agg(F.avg("__target").alias("value"))
            first = ranking.first_rows(means, ["column"], [F.asc("key")], groups)
            parts.append(first.select("column", F.lit("mean").alias("kind"), "key", "value"))
        return reduce(DataFrame.unionByName, parts)

    # -- everything -----------------------------------------------------------

    def run_full_analysis(self) -> DataFrame:
        """All sections as one table (section, column, stat, value, text)."""

        def section(name: str, rows: DataFrame, column: Column, stat: Column, value: Column, text: Column | None = None) -> DataFrame:
            nothing = F.lit(None).cast("string")
            return rows.select(F.lit(name).alias("section"), column.alias("column"), stat.alias("stat"),
                               value.cast("double").alias("value"), (text if text is not None else nothing).alias("text"))

        col = F.col
        parts = [
            section("basic_info", self.basic_info(), col("column"), col("stat"), col("value"), col("text")),
            section("summary", self.numeric_summary(), col("column"), col("stat"), col("value")),
            section("correlation", self.correlation_matrix(), col("feature_1"), col("feature_2"), col("correlation")),
            section("missing", self.missing_values_analysis(), col("column"), F.lit("percent"), col("percent")),
            section("histogram", self.distribution_analysis(), col("column"), col("bin").cast("string"), col("n")),
            section("categories", self.categorical_analysis(), col("column"), col("rank").cast("string"), col("n"), col("value")),
            section("outliers", self.outlier_analysis(), col("column"), F.lit("outliers"), col("outliers")),
            section("bivariate", self.bivariate_analysis(), col("feature_1"), col("feature_2"), col("correlation")),
        ]
        if self.target_column:
            parts.append(section("target", self.target_analysis(), col("column"), col("kind"), col("value"), col("key")))
        return reduce(DataFrame.unionByName, parts)
