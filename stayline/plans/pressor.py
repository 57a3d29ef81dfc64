"""Vasoactive drugs: hourly mean rates and daily maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.clinical import has_item, offset_of
from ..functions.numbers import decimals, numeric
from ..operators.grid import every_hour, with_length
from ..operators.intervals import stabbed_minutes
from ..operators.shape import by_day, greatest_day

MINUTE_CAP = 7 * 24 * 60


def infusions(inputevents: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per stay, drug and start time for all drugs at once: offsets and highest rate.

    ``lengths`` is ``with_length(stays)``; the length of stay rides along as ``los_min``.
    """
    names = F.create_map(*[F.lit(x) for pair in codes.PRESSOR_ITEMS.items() for x in pair])
    rows = inputevents.filter(has_item(list(codes.PRESSOR_ITEMS))).withColumn(
        "drug", F.element_at(names, F.col("itemid").cast("int"))
    )
    for drug, limit in codes.RATE_BELOW.items():
        rows = rows.filter((F.col("drug") != drug) | (F.col("rate") < limit))
    return (
        rows.join(lengths, "stay_id")
        .groupBy("stay_id", "drug", "starttime")
        .agg(
            F.min(offset_of("starttime")).alias("begin_offset"),
            F.min(offset_of("endtime")).alias("end_offset"),
            F.max(numeric(F.col("rate"))).alias("rate"),
            F.max("los_min").alias("los_min"),
        )
    )


def hourly(inputevents: DataFrame, stays: DataFrame, minute_cap: int = MINUTE_CAP) -> DataFrame:
    """Mean rate per stay, hour and drug, and the weighted total.

    An hour's mean is over the minutes of the stay that lie in it: 60, or fewer in the last
    hour.  Minutes without an infusion count as 0.
    """
    lengths = with_length(stays).filter(F.col("los_min") >= 0)
    last_minute = F.least(F.col("los_min"), F.lit(minute_cap - 1))

    running = (
        infusions(inputevents, lengths)
        .filter(F.col("begin_offset").isNotNull() & F.col("end_offset").isNotNull())
        .withColumn("first", F.greatest("begin_offset", F.lit(0)))
        .withColumn("last", F.least(F.col("end_offset") - 1, last_minute))
        .filter(F.col("first") <= F.col("last"))
    )
    covered = stabbed_minutes(running, ["stay_id", "drug"], "first", "last", "rate")
    sums = covered.groupBy("stay_id", "hr").agg(
        *[
            F.expr(f"coalesce(sum(case when drug = '{d}' then rate_minutes end), 0D) as {d}")
            for d in codes.PRESSORS
        ],
    )
    minutes = F.least(F.col("hr") * 60 + 59, F.col("last")) - F.col("hr") * 60 + 1
    sums = every_hour(sums, lengths.select("stay_id", last_minute.alias("last"))).withColumn("minutes", minutes)
    weighted = " + ".join(f"{d} / {n}" for d, n in codes.EQUIVALENT_DIVISORS.items())
    return sums.select(
        "stay_id",
        "hr",
        *[F.expr(f"{d} / minutes as {d}") for d in codes.PRESSORS],
        F.expr(f"({weighted}) / minutes as vasopressor_rate"),
    )


def daily(pressor_hourly: DataFrame, days: int = 5) -> DataFrame:
    """Highest rounded hourly mean of each day, side by side, for stays with a first day."""
    cells = [by_day("hr div 24", name, days, name) for name in codes.DAILY_DECIMALS]
    wide = (
        pressor_hourly.filter(F.col("hr") < days * 24)
        .groupBy("stay_id")
        .agg(
            F.max(F.when(F.col("hr") < 24, 1)).alias("_day_1"),
            *[c for per_name in cells for c in per_name],
        )
        .filter(F.col("_day_1") == 1)
    )
    # rounding keeps the order, so the highest rounded value is the highest value rounded
    ordered = [
        decimals(F.col(f"d{d}_{name}"), places).alias(f"d{d}_{name}")
        for d in range(1, days + 1)
        for name, places in codes.DAILY_DECIMALS.items()
    ]
    return wide.select("stay_id", *ordered).select(
        "*",
        greatest_day(days, "dobutamin", "max_dobutamin"),
        greatest_day(days, "milrinone", "max_milrinone"),
        greatest_day(days, "vasopressor_rate", "max_vasopressor"),
    )
