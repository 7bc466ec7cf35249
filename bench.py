"""Time the headline queries; prints one JSON line. BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from gridsmith.registry import load
from gridsmith.session import session

HEADLINE = [
    "x2_registry_stats", "x2_registry_stats_quick", "j1_unit_operator_chain", "a3_capacity_by_source", "a7_group_counts", "a12_percentiles", "a15_status_rollup", "j8_batched_lookup", "j10_band_join",
    "w2_best_candidate", "w6_cross_type_dedup", "k2_upsert_facts", "k12_review_transitions", "x1_hybrid_search", "x9_search_response", "x10_bulk_planner", "n7_importance", "c8_classify_files", "m5_links", "g15_level_normalization", "r1_session_limit",
]


def main() -> None:
    folder, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(f"local[{cpus}]", int(cpus), "8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    times: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):  # the first compiles
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(median(took[1:]), 3)
        print(name, times[name], file=sys.stderr)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total of the medians of the headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
