"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names to run in place of the default list
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from harmonium.plans.catalog import QUERIES  # noqa: E402
from harmonium.session import drop_materialised  # noqa: E402

HEADLINE = [
    "fea9_artist_metadata",
    "win5_user_split",
    "fea7_user_scaling",
    "fea10_interaction_table",
    "mat16_unified_mapping",
    "rec3_top_items",
    "rec13_survey_recommendations",
    "rec9_metrics",
    "rec8_auc",
    "eda11_full_profile",
    "agg1_listeners",
    "agg2_artist_tags",
    "agg3_artist_statistics",
    "win1_most_popular_track",
    "set6_duplicate_rows",
    "joi9_null_audit",
    "str2_latest_submission",
    "str3_recommendations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths and the Python workers before timing
    for warm in ("agg1_listeners", "rec3_top_items"):
        QUERIES[warm](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    drop_materialised(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
