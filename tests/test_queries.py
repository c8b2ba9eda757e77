"""A sample of the registered queries against their SQL; tools/check_queries.py runs them all."""

import sys

import duckdb
import pytest
from conftest import ROOT

sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry
from check_queries import canonical

SAMPLE = ["fea9_artist_metadata", "win4_random_split", "mat16_unified_mapping", "mat9_nearest_name", "rec3_top_items_unseen", "rec8_auc",
          "rec13_survey_recommendations", "eda6_histograms", "eda7_top_categories", "joi9_null_audit", "str3_recommendations"]


@pytest.fixture(scope="module")
def con(folder):
    from pathlib import Path

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, folder, name):
    got = entry.queries()[name](spark, folder).toPandas()
    expected = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
