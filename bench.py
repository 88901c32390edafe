"""Time the headline queries: one warm-up, then one timed run each, written to the noop sink.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

from __future__ import annotations

import json
import os
import time

from inversia.queries import REGISTRY
from inversia.session import build_session, clear_run

HEADLINE = (
    "inversion_events",
    "event_summary",
    "feature_build",
    "rolling",
    "gap_analysis",
    "completeness_report",
    "complete_chunks",
    "missing_log",
    "linear_fill",
    "fill_all",
    "forward_backward_fill",
    "clean_extremes",
    "nearest_grid_point",
    "raster_region",
    "weighted_density",
    "field_metrics",
    "chronological_split",
    "permutation_importance",
    "forest_importance",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("inversia-bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    clear_run(spark)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
