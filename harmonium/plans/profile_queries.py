"""Queries for data profiling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from harmonium.operators.profiling import EDA
from harmonium.plans.registry import query, r, with_views
from harmonium.sources import views
from harmonium.sources.views import V_TRACKS

_LINE = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
         "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"}
_NUMERIC = [c for c, k in _LINE.items() if k in ("bigint", "int", "double")]
_TEXTS = ["l_returnflag", "l_linestatus"]
WT = with_views(V_TRACKS)


def _lines(spark, folder):
    return views.table(spark, folder, "lineitem").select(*[F.col(c).cast("timestamp") if k == "timestamp" else F.col(c) for c, k in _LINE.items()])


def _union(parts):
    return "\nUNION ALL ".join(parts)


@query("eda1_basic_info", _union(
    [f"""SELECT '{c}' AS "column", 'missing' AS stat, (COUNT(*) - COUNT({c}))::DOUBLE AS value, CAST(NULL AS VARCHAR) AS text FROM lineitem""" for c in _LINE]
    + [f"SELECT '{c}', 'dtype', NULL, '{k}'" for c, k in _LINE.items()]
    + [f"SELECT '*', 'dtype_count', {list(_LINE.values()).count(k)}.0, '{k}'" for k in sorted(set(_LINE.values()))]
    + ["SELECT '*', 'rows', COUNT(*)::DOUBLE, NULL FROM lineitem", f"SELECT '*', 'columns', {len(_LINE)}.0, NULL",
       "SELECT '*', 'missing', (" + " + ".join(f"COUNT(*) - COUNT({c})" for c in _LINE) + ")::DOUBLE, NULL FROM lineitem",
       "SELECT '*', 'duplicate_rows', (SUM(n - 1))::DOUBLE, NULL FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY ALL_COLUMNS) t".replace("ALL_COLUMNS", ", ".join(_LINE))]))
def eda1(spark, folder):
    return EDA(_lines(spark, folder)).basic_info()


_STATS = {"count": "COUNT({c})", "mean": "AVG({c})", "std": "STDDEV_SAMP({c})", "min": "MIN({c})", "25%": "QUANTILE_CONT({c}::DOUBLE, 0.25)",
          "50%": "QUANTILE_CONT({c}::DOUBLE, 0.5)", "75%": "QUANTILE_CONT({c}::DOUBLE, 0.75)", "max": "MAX({c})"}


@query("eda2_numeric_summary", _union(f"""SELECT '{c}' AS "column", '{s}' AS stat, ROUND(({e.format(c=c)})::DOUBLE, 4) AS value FROM lineitem""" for c in _NUMERIC for s, e in _STATS.items()))
def eda2(spark, folder):
    return EDA(_lines(spark, folder)).numeric_summary().withColumn("value", r("value", 4))


@query("eda3_correlations", _union(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, ROUND(CORR({a}, {b}), 6) AS correlation FROM lineitem" for a in _NUMERIC for b in _NUMERIC))
def eda3(spark, folder):
    return EDA(_lines(spark, folder)).correlation_matrix().withColumn("correlation", r("correlation"))


@query("eda4_top_correlations", "WITH c AS (" + _union(f"SELECT '{min(a, b)}' AS feature_1, '{max(a, b)}' AS feature_2, CORR({a}, {b}) AS c FROM lineitem" for a, b in combinations(_NUMERIC, 2))
       + ") SELECT feature_1, feature_2, ROUND(c, 6) AS correlation, ROUND(ABS(c), 6) AS abs_corr FROM c ORDER BY ABS(c) DESC, feature_1, feature_2 LIMIT 10")
def eda4(spark, folder):
    return EDA(_lines(spark, folder)).top_correlations(10).withColumns({"correlation": r("correlation"), "abs_corr": r("abs_corr")})


@query("eda5_missing_values", WT + "SELECT * FROM (" + _union(f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing, ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 6) AS percent FROM v_tracks"""
       for c in ("track_name", "popularity", "tempo", "energy", "duration_ms", "loudness", "explicit", "track_genre")) + ") t WHERE missing > 0")
def eda5(spark, folder):
    return EDA(views.tracks(spark, folder)).missing_values_analysis().withColumn("percent", r("percent"))


def _bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    """Bin number of a value; values on an edge belong to the upper bin, the maximum to the last one."""
    place = f"LEAST(FLOOR(({x} - {lo}) / ({hi} - {lo}) * {bins}.0::DOUBLE), {bins - 1})"
    step = f"(({hi} - {lo}) / {bins}.0::DOUBLE)"
    return (f"({place} - CASE WHEN {x} < {place} * {step} + {lo} THEN 1 ELSE 0 END"
            f" + CASE WHEN {place} < {bins - 1} AND {x} >= ({place} + 1) * {step} + {lo} THEN 1 ELSE 0 END)::INTEGER")


@query("eda6_histograms", "WITH " + ", ".join(
    f"""g_{c} AS (SELECT {_bin_sql(f"{c}::DOUBLE", "lo", "hi", 30)} AS bin, COUNT(*) AS n FROM lineitem,
    (SELECT MIN({c})::DOUBLE AS lo, MAX({c})::DOUBLE AS hi FROM lineitem) s WHERE {c} IS NOT NULL GROUP BY 1)""" for c in _NUMERIC) + "\n" + _union(
    f"""SELECT '{c}' AS "column", i::INTEGER AS bin, ROUND(lo + (hi - lo) * i / 30, 4) AS low, ROUND(lo + (hi - lo) * (i + 1) / 30, 4) AS high, COALESCE(n, 0) AS n
    FROM RANGE(0, 30) b(i) CROSS JOIN (SELECT MIN({c})::DOUBLE AS lo, MAX({c})::DOUBLE AS hi FROM lineitem) s LEFT JOIN g_{c} ON bin = i""" for c in _NUMERIC))
def eda6(spark, folder):
    return EDA(_lines(spark, folder)).distribution_analysis().withColumns({"low": r("low", 4), "high": r("high", 4)})


@query("eda6_scatter_counts", f"""SELECT {_bin_sql("l_quantity", "ql", "qh", 20)} AS x_bin, {_bin_sql("l_extendedprice", "pl", "ph", 20)} AS y_bin, COUNT(*) AS n
FROM lineitem, (SELECT MIN(l_quantity) AS ql, MAX(l_quantity) AS qh, MIN(l_extendedprice) AS pl, MAX(l_extendedprice) AS ph FROM lineitem) s GROUP BY 1, 2""")
def eda6_scatter(spark, folder):
    return EDA(_lines(spark, folder)).scatter_counts("l_quantity", "l_extendedprice")


@query("eda7_top_categories", WT + "SELECT * FROM (" + _union(f"""SELECT '{c}' AS "column", {c} AS value, COUNT(*) AS n, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) AS INTEGER) AS rank
FROM v_tracks WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ("track_id", "track_name", "track_genre")) + ") t WHERE rank <= 15")
def eda7(spark, folder):
    return EDA(views.tracks(spark, folder)).categorical_analysis()


@query("eda8_outliers", _union(f"""SELECT '{c}' AS "column", ROUND(q1, 4) AS q1, ROUND(q2, 4) AS median, ROUND(q3, 4) AS q3, ROUND(q3 - q1, 4) AS iqr,
(SELECT COUNT(*) FROM events WHERE {c}::DOUBLE < q1 - 1.5 * (q3 - q1) OR {c}::DOUBLE > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT QUANTILE_CONT({c}::DOUBLE, 0.25) AS q1, QUANTILE_CONT({c}::DOUBLE, 0.5) AS q2, QUANTILE_CONT({c}::DOUBLE, 0.75) AS q3 FROM events) q""" for c in ("event_id", "user_id", "value")))
def eda8(spark, folder):
    return EDA(views.table(spark, folder, "events")).outlier_analysis().withColumns({c: r(c, 4) for c in ("q1", "median", "q3", "iqr")})


@query("eda9_bivariate", _union(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, ROUND(CORR({a}, {b}), 6) AS correlation FROM lineitem" for a, b in list(combinations(_NUMERIC, 2))[:15]))
def eda9(spark, folder):
    return EDA(_lines(spark, folder)).bivariate_analysis().withColumn("correlation", r("correlation"))


@query("eda10_target", _union(
    [f"""SELECT '{c}' AS "column", 'correlation' AS kind, CAST(NULL AS VARCHAR) AS key, ROUND(CORR({c}, l_extendedprice), 6) AS value FROM lineitem""" for c in _NUMERIC if c != "l_extendedprice"]
    + [f"SELECT * FROM (SELECT '{c}', 'mean', {c}, ROUND(AVG(l_extendedprice), 4) FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY {c} LIMIT 20) t" for c in _TEXTS]))
def eda10(spark, folder):
    rows = EDA(_lines(spark, folder), "l_extendedprice").target_analysis()
    return rows.withColumn("value", F.when(F.col("kind") == "mean", r("value", 4)).otherwise(r("value")))


@query("eda11_full_profile")
def eda11(spark, folder):
    return EDA(_lines(spark, folder), "l_extendedprice").run_full_analysis()
