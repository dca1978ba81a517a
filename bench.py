"""Benchmark: the composite queries on one set of tables, one JSON line out.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores). Each query runs
once to warm up, then the median of three runs counts; results go to Spark's
no-op sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tablecraft.session import build_session
from tablecraft.sources import discard
from verification.queries import queries

HEADLINE = (
    "extract_orders",
    "extract_returns",
    "extract_inventory",
    "agg_revenue",
    "agg_refunds",
    "check_stock",
    "build_report",
    "daily_report",
    "user_behavioral",
    "user_demographic",
    "item_engagement",
    "item_catalog",
    "feature_latest",
    "feature_asof",
    "churn_training_raw",
    "churn_features",
    "scaled_features",
    "binary_metrics",
    "extract_interactions",
    "user_item_features",
    "user_profiles",
    "interaction_matrix",
    "ranking_metrics",
)
# Iterative fits: one warm run each.
FITS = ("churn_metrics", "nmf_factors")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = queries()
    seconds = {}
    for name in HEADLINE + FITS:
        runs = []
        for _ in range(4 if name in HEADLINE else 2):
            started = time.perf_counter()
            discard(registry[name](spark, sf_dir))
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs[1:]), 4)
    print(
        json.dumps(
            {
                "metric": "total_seconds_of_headline_queries",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
