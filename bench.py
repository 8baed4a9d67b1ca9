"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

import workload

HEADLINE = [
    "stage_lead_times",
    "current_status",
    "bottleneck_summary",
    "asset_delay_summary",
    "spare_waiting_summary",
    "follow_up_queue",
    "queue_summary",
    "check_impact_issues",
    "check_stage_progression",
    "check_all_issues",
    "core_check_failures",
    "raw_load_rows",
    "core_events",
    "downstream_assets",
    "core_triples",
    "runtime_shape_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    workload.QUERIES["check_zone_vocabulary"](spark, folder).write.format("noop").mode("overwrite").save()
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    times = {}
    for name in wanted:
        started = time.perf_counter()
        workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
