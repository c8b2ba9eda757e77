import numpy as np
import pandas as pd
import pytest
from conftest import rows

from harmonium.operators import quantiles
from harmonium.operators.profiling import EDA


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(42)
    df = pd.DataFrame({"a": rng.normal(size=400), "b": rng.uniform(0, 5, 400).round(2), "n": rng.integers(0, 9, 400), "g": rng.choice(list("xyz"), 400), "flat": 3.0})
    df["t"] = df["a"] * 2 + rng.normal(size=400)
    df.loc[rng.choice(400, 30, replace=False), "a"] = np.nan
    df.loc[rng.choice(400, 20, replace=False), "g"] = None
    return df


@pytest.fixture(scope="module")
def eda(spark, frame):
    data = [tuple(None if pd.isna(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    return EDA(spark.createDataFrame(data, "a double, b double, n int, g string, flat double, t double"), "t")


def test_basic_info(eda):
    got = {(r["column"], r["stat"], r["text"]): r["value"] for r in eda.basic_info().collect()}
    assert got["*", "rows", None] == 400 and got["*", "columns", None] == 6 and got["*", "missing", None] == 50
    assert got["a", "missing", None] == 30 and got["*", "duplicate_rows", None] == 0
    assert ("g", "dtype", "string") in got and got["*", "dtype_count", "double"] == 4


def test_summary_matches_pandas(eda, frame):
    got = {(r["column"], r["stat"]): r["value"] for r in eda.numeric_summary().collect()}
    for c, stats in frame.select_dtypes("number").describe().to_dict().items():
        for s, v in stats.items():
            assert got[c, s] == pytest.approx(v), (c, s)


def test_correlations_match_pandas(eda, frame):
    want = frame.select_dtypes("number").corr()
    got = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in eda.correlation_matrix().collect()}
    assert len(got) == 25
    for (a, b), v in got.items():
        assert (v is None and np.isnan(want.loc[a, b])) or v == pytest.approx(want.loc[a, b])
    top = eda.top_correlations(2).collect()
    assert (top[0]["feature_1"], top[0]["feature_2"]) == ("a", "t")
    assert eda.bivariate_analysis().count() == 10


def test_missing_values(eda):
    assert rows(eda.missing_values_analysis()) == [("a", 30, 7.5), ("g", 20, 5.0)]


def test_histograms_match_numpy(eda, frame):
    got = eda.distribution_analysis().collect()
    for c in ("a", "b", "n", "flat", "t"):
        counts, edges = np.histogram(frame[c].dropna(), bins=30)
        mine = sorted((r["bin"], r["n"], r["low"]) for r in got if r["column"] == c)
        assert [n for _, n, _ in mine] == counts.tolist()
        assert [lo for _, _, lo in mine] == pytest.approx(edges[:-1].tolist())


def test_categories(eda, frame):
    want = frame["g"].value_counts()
    assert {r["value"]: r["n"] for r in eda.categorical_analysis().collect()} == want.to_dict()


def test_outliers(eda, frame):
    got = {r["column"]: r["outliers"] for r in eda.outlier_analysis().collect()}
    for c in frame.select_dtypes("number"):
        q1, q3 = frame[c].quantile([0.25, 0.75])
        spread = 1.5 * (q3 - q1)
        assert got[c] == ((frame[c] < q1 - spread) | (frame[c] > q3 + spread)).sum()


def test_target(eda, frame):
    got = {(r["column"], r["kind"], r["key"]): r["value"] for r in eda.target_analysis().collect()}
    assert got["a", "correlation", None] == pytest.approx(frame["a"].corr(frame["t"]))
    for key, mean in frame.groupby("g")["t"].mean().items():
        assert got["g", "mean", key] == pytest.approx(mean)


def test_scatter_counts(eda):
    assert sum(r["n"] for r in eda.scatter_counts("b", "t").collect()) == 400


def test_full_profile(eda):
    sections = {r["section"] for r in eda.run_full_analysis().select("section").distinct().collect()}
    assert sections == {"basic_info", "summary", "correlation", "missing", "histogram", "categories", "outliers", "bivariate", "target"}


def test_edges(spark):
    empty = EDA(spark.createDataFrame([], "a double, g string"))
    assert {r["stat"]: r["value"] for r in empty.basic_info().filter("column = '*' and text is null").collect()}["rows"] == 0
    assert empty.outlier_analysis().count() == 0 and empty.distribution_analysis().count() == 0
    assert empty.target_analysis().count() == 0 and empty.missing_values_analysis().count() == 0
    texts = EDA(spark.createDataFrame([("x",)], "g string"))
    assert texts.numeric_summary().count() == 0 and texts.correlation_matrix().count() == 0 and texts.bivariate_analysis().count() == 0
    flags = EDA(spark.createDataFrame([(True, 1)], "f boolean, i int"))
    assert flags.numeric == ["i"]


@pytest.mark.parametrize("limit", [1, 7, 5000])
def test_percentiles_of_all_columns_side_by_side(spark, limit, monkeypatch):
    rng = np.random.default_rng(8)
    n = 40_000
    data = {"normal": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float), "skewed": np.exp(rng.normal(0, 6, n)),
            "hot": np.where(rng.random(n) < 0.4, 3.0, rng.normal(3, 1e-9, n)), "one": np.full(n, 2.5)}
    frame = pd.DataFrame(data)
    frame.loc[frame.index % 3 == 0, "ties"] = None
    frame["empty"] = pd.Series([None] * n, dtype="float64")
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in frame)).repartition(5)
    passes = []
    monkeypatch.setattr(quantiles, "_STEPS", 50)
    kind, first = type(df), type(df).first
    monkeypatch.setattr(kind, "first", lambda self: passes.append(1) or first(self))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in quantiles.percentiles(df, list(frame), probs, limit=limit).collect()}
    assert set(got) == {(c, p) for c in data for p in probs}
    for (c, p), v in got.items():
        assert v == pytest.approx(np.nanpercentile(frame[c].astype(float), 100 * p), rel=1e-12, abs=1e-300)
    assert len(passes) <= (6 if limit == 5000 else 9)  # one of them counts the rows


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (3.0, None), (None, 4)], "a double, b int")
    eda = EDA(df)
    got = {(r["column"], r["stat"]): r["value"] for r in eda.numeric_summary().collect()}
    assert got["a", "count"] == 2 and got["a", "mean"] == 2.0 and got["a", "max"] == 3.0 and got["a", "75%"] == 2.5 and got["a", "std"] == pytest.approx(2**0.5)
    assert {(r["column"], r["missing"]) for r in eda.missing_values_analysis().collect()} == {("a", 2), ("b", 1)}
    assert {r["value"] for r in eda.basic_info().where("column = 'a' and stat = 'missing'").collect()} == {2.0}
