"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The four benchmark shapes follow the published protocol: one warm-up, five measured runs
with the full result fetched, median kept.  The other queries report the better of two runs
after one warm-up, written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from fieldglass.catalog import library
from fieldglass.session import local_session

SHAPES = ["x15_b1_full_scan_aggregate", "x15_b2_recent_filter_aggregate", "x15_b3_context_join", "x15_b4_partitioned_window"]
OTHERS = [
    "p1_fact_pitch", "a1_pitch_type_summary", "a2_count_strategy", "a9_dashboard_summary", "m1_pitch_model_features", "m2_training_whiff",
    "w1_latest_line", "w5_prior_rows", "w6_prior_14d", "w13_average_rank_percentile", "w14_unique_rank", "j4_star_join", "j15_nearest_2h",
    "j19_compare_counts", "a34_box_plots", "t4_top_k_per_group", "m5_evaluation",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    queries, seconds = library.queries(), {}
    for name in SHAPES:
        fetch = lambda: queries[name](spark, folder).toArrow()  # noqa: B023, E731
        fetch()
        seconds[name] = round(statistics.median(timed(fetch) for _ in range(5)), 4)
    for name in OTHERS:
        run = lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()
        seconds[name] = round(min(timed(run) for _ in range(2)), 4)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": cores, "shape_protocol": "1 warm-up, median of 5, full fetch",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
