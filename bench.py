"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores. Every query
runs to completion on its own: cached rows of the query before it are dropped first.
"""

from __future__ import annotations

import json
import os
import re
import time

from variscope.catalog import load
from variscope.session import local_session

HEADLINE = [
    "scope_totals",
    "median_baseline",
    "group_dimension",
    "score_dimensions",
    "find_interactions",
    "category_rank",
    "drill",
    "finance_points",
    "rolling_median_baseline",
    "period_summary",
    "model_health",
    "monthly_benchmark",
    "top_n_per_dimension",
    "dimension_matrix",
    "hierarchy_children",
    "forecast_backtest",
    "event_study",
    "column_profile",
    "quality_dimensions",
    "functional_dependencies",
    "duplicate_rows",
    "normalize_long",
    "hierarchy_depth",
    "sentiment_tag",
    "mention_join",
    "mention_join_long_list",
    "why_factor_score",
    "grounding_check_documents",
    "validate_snapshot",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus, partitions=max(int(cpus) * 2, 8), app="variscope-bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = load()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start executors and file system
    took: dict[str, float] = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        started = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(found.group(1)) if found else None,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
