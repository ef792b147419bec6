"""Time the headline queries: one warm-up, then the median of three runs. Prints one JSON line.

The registry and the responses are written as tables first, as they would arrive; that is not timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from workload import catalogue
from workload.fixtures import Fixture

QUERIES = [
    "prj_registry_clean", "src_responses_modern", "join_calendar_range", "join_replace_by_key", "agg_sample_sizes",
    "agg_specific_variance", "job_month_inst", "job_month_inst_variance", "job_month_prepost", "job_annual",
]
INPUTS = [
    "licence_raw", "licence_draw", "response_raw", "response_year", "legacy_raw", "adjust_raw", "exclude_ids",
    "vendor_wide",
]
RUNS = 3
# Whole jobs, files in and files out, with their inputs written in the time. Not part of the total; timed once warm.
JOBS = ["job_month", "job_annual_run"]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "6g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(cpus)
    folder = tempfile.mkdtemp(prefix="bench-")
    raw, prepared = Fixture(spark, data), {}
    for name in INPUTS:
        prepared[name] = f"{folder}/{name}"
        raw.view(name).repartition(int(cpus)).write.parquet(prepared[name])

    def timed(name: str, runs: int) -> float:
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            frame = catalogue.CATALOGUE[name](Fixture(spark, data, prepared))
            frame.write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        took = round(statistics.median(seconds[1:]), 3)
        print(name, took, file=sys.stderr, flush=True)
        return took

    timings = {name: timed(name, RUNS) for name in QUERIES}
    jobs = {name: timed(name, 1) for name in JOBS}
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "jobs": jobs, "sf": Path(data).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
