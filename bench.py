"""Headline queries, timed.  Prints one JSON line.

The clinical stand-in tables are derived from the driver tables first and reported as
``prepare``, the cohort stage that four queries start from as ``cohort``; every query is then run once untimed-for-JVM-warm-up and ``BENCH_REPEAT`` times,
of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from checks.catalog import QUERIES
from checks.standins import NAMES, clinical_tables
from stayline.session import tune

HEADLINE = [
    "infusion_extract",
    "rate_hourly_mean",
    "rate_daily_max_wide",
    "procedure_dedup",
    "procedure_pivot",
    "bolus_merge",
    "order_rollup",
    "void_rate",
    "prorate_intake",
    "prorate_void",
    "hourly_balance_running",
    "daily_balance_wide",
    "exposed_only",
    "drug_episodes",
    "post_procedure_changes",
    "block_score_lead",
    "block_panel",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    tables = clinical_tables(tune(spark), folder)
    for name in NAMES:
        tables[name]
    prepare = time.time() - start
    start = time.time()
    QUERIES["block_grid_rows"](spark, folder).count()  # the first query on the cohort builds its stage
    cohort = time.time() - start

    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeat + 1):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "prepare": round(prepare, 3),
                "cohort": round(cohort, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
