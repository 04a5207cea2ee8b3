"""Time the registered queries: one warm-up, then the median of three runs each.

Reads ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]`` and prints one JSON line.  Results go to
Spark's ``noop`` sink, so every row and column is computed and nothing is collected.
``BENCH_QUERIES`` (comma-separated) narrows the list, ``BENCH_RUNS`` sets the runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from oreline.plans.queries import QUERIES
from oreline.sources.paths import clear_scratch

# Both marts, the fact, the dimension and the gate, with their incremental forms; the
# queries left out are parts of these.
HEADLINE = [
    "bronze_append",
    "scd2_detect_changes",
    "scd2_apply",
    "dim_insert_new",
    "fact_sales",
    "fact_incremental",
    "gold_daily_sales",
    "gold_customer_segments",
    "gold_daily_incremental",
    "gold_segments_incremental",
    "time_travel_rows",
    "compact_files",
    "expire_snapshots",
    "dq_unique",
    "dq_fk",
    "dq_suite",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("oreline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="oreline-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
