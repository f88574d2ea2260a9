"""Times of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "traj_level_cell",
    "traj_signature",
    "prune_cells",
    "range_candidates_noprune",
    "range_candidates_pruned",
    "quadcode_intervals",
    "quadorder_intervals",
    "compare_orders",
    "partition_choice",
    "cell_jaccard",
    "static_features",
    "dataset_report",
    "range_exact_segments",
    "parse_wkt",
    "interpolate",
)


def main() -> None:
    from wayquad.plans.catalog import QUERIES
    from wayquad.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
