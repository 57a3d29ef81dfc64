"""The direct plans (full grids and range joins) against the library's, timed in one session.

    python -m checks.naive <folder>
"""

from __future__ import annotations

import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions import codes
from stayline.operators.grid import hour_grid, spread, with_length
from stayline.operators.intervals import rate_minutes
from stayline.plans import fluid, pressor
from stayline.session import tune

from .standins import clinical_tables


def rates_on_minute_grid(t) -> DataFrame:
    lengths = with_length(t["icustay_times"])
    last = F.least(F.col("los_min"), F.lit(pressor.MINUTE_CAP - 1))
    grid = spread(lengths.filter(F.col("los_min") >= 0), F.lit(0), last, "minute").select("stay_id", "minute")
    drugs = pressor.infusions(t["inputevents"], lengths).drop("los_min")
    running = (F.col("begin_offset") <= F.col("minute")) & (F.col("minute") < F.col("end_offset"))
    highest = (
        grid.join(drugs, "stay_id").filter(running).groupBy("stay_id", "minute").agg(
            *[F.max(F.when(F.col("drug") == d, F.col("rate"))).alias(d) for d in codes.PRESSORS]
        )
    )
    return (
        grid.join(highest, ["stay_id", "minute"], "left")
        .groupBy("stay_id", F.floor(F.col("minute") / 60).alias("hr"))
        .agg(*[F.avg(F.coalesce(d, F.lit(0.0))).alias(d) for d in codes.PRESSORS])
    )


def rates_by_mask(t) -> DataFrame:
    return pressor.hourly(t["inputevents"], t["icustay_times"]).drop("vasopressor_rate")


def intake_by_range_join(t) -> DataFrame:
    lengths = with_length(t["icustay_times"])
    low, high = F.col("hr") * 60, F.col("hr") * 60 + 60
    orders = fluid.orders(t["inputevents"], lengths)
    start, end = F.col("start_offset"), F.col("end_offset")
    share = rate_minutes(start, end, low, high, F.col("rate"), F.col("amount") * 60, F.col("amount") * 60)
    hits = hour_grid(lengths).join(orders, "stay_id").filter((start < high) & (end > low))
    return hits.groupBy("stay_id", "hr", "kind").agg(F.sum(share).alias("value"))


def intake_by_bucket(t) -> DataFrame:
    orders = fluid.orders(t["inputevents"], with_length(t["icustay_times"]))
    shares = fluid.hour_shares(orders, F.col("amount") * 60)
    return shares.groupBy("stay_id", "hr", "kind").agg(F.sum("value").alias("value"))


def main(folder: str) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = clinical_tables(tune(spark), folder)
    for plan in (rates_by_mask, rates_on_minute_grid, intake_by_bucket, intake_by_range_join):
        runs = []
        for _ in range(3):
            start = time.time()
            plan(t).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        print(f"{plan.__name__}: {statistics.median(runs):.2f} s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
