"""Intervals against regular buckets: proration, and the mean of a per-minute maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import HOUR
from .grid import spread


def overlapped_buckets(
    df: DataFrame, start: str, end: str, width: int, last: Column, name: str
) -> DataFrame:
    """One row per bucket ``k`` of ``0..last`` with ``start < (k+1)*width and end > k*width``.

    The bounds are clipped to the grid before anything is exploded, so an end time charted
    years late costs no more rows than the stay has buckets.
    """
    # greatest() and least() skip NULL, so open-ended rows and stays of unknown length go first
    df = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & last.isNotNull())
    first_hit = F.greatest(F.floor(F.col(start) / width), F.lit(0))
    last_hit = F.least(F.ceil(F.col(end) / width) - 1, last)
    return spread(df, first_hit, last_hit, name)


def rate_minutes(
    start: Column, end: Column, low: Column, high: Column, rate: Column, inside: Column,
    no_rate: Column,
) -> Column:
    """Share of an interval in the bucket ``[low, high]``, as amount x 60.

    A share of a rate is minutes x rate / 60; the division is left to the very end.  ``inside``
    is the value for an interval that lies in the bucket, ``no_rate`` the one for an interval
    without a rate.
    """
    overlap = F.least(end, high) - F.greatest(start, low)
    whole = (start >= low) & (end <= high)
    return F.when(rate.isNull(), no_rate).when(whole, inside).otherwise(overlap * rate)


def stabbed_minutes(
    segments: DataFrame, keys: list[str], begin: str, end: str, rate: str
) -> DataFrame:
    """Per group and hour: sum over minutes of the highest rate running in that minute.

    ``begin..end`` are whole minutes, both included.  Instead of a row per minute, an
    interval is cut at full hours and its minutes become a 60-bit mask.  Identical masks
    collapse to their highest rate while still map-side, so a group never holds more than
    the 60 * 61 / 2 = 1830 masks an hour can have, however many rows it started from.
    Going down the rates, each one then counts the minutes no higher rate has taken.

    Returns ``keys + hr, rate_minutes``.
    """
    lo, hi, hr = F.col(begin), F.col(end), F.col("hr")
    cut = (
        spread(segments.filter(F.col(rate).isNotNull()), F.floor(lo / HOUR), F.floor(hi / HOUR), "hr")
        .withColumn("_from", F.greatest(lo, hr * HOUR) - hr * HOUR)
        .withColumn("_to", F.least(hi, hr * HOUR + HOUR - 1) - hr * HOUR)
        .groupBy(*keys, "hr", "_from", "_to")
        .agg(F.max(rate).alias("_rate"))
        .withColumn(
            "_mask",
            F.expr("shiftleft(shiftleft(1L, cast(_to - _from + 1 as int)) - 1L, cast(_from as int))"),
        )
    )
    higher = (
        Window.partitionBy(*keys, "hr")
        .orderBy(F.col("_rate").desc(), "_from", "_to")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    taken = F.coalesce(F.bit_or("_mask").over(higher), F.lit(0).cast("bigint"))
    left = F.bit_count(F.col("_mask").bitwiseAND(F.bitwise_not(taken)))
    return (
        cut.withColumn("_minutes", left)
        .groupBy(*keys, "hr")
        .agg(F.sum(F.col("_rate") * F.col("_minutes")).alias("rate_minutes"))
    )
