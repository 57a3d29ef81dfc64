"""Relative time: whole minutes and days between two timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 60
BLOCK = 240
DAY = 1440


def minutes_between(since: Column, until: Column) -> Column:
    """Whole minutes from ``since`` to ``until``, cut toward zero (may be negative).

    Goes through the interval type, which needs no time zone for TIMESTAMP_NTZ;
    ``timestamp_diff`` would read both ends in the session zone and jump at DST changes.
    """
    return (until - since).cast("interval minute").cast("bigint")


def days_between(since: Column, until: Column) -> Column:
    """Whole days from ``since`` to ``until``, cut toward zero."""
    return (until - since).cast("interval day").cast("bigint")


def rounded_units(minutes: Column, width: int) -> Column:
    """``minutes / width`` rounded to the nearest whole unit, halves away from zero."""
    return F.round(minutes / F.lit(width)).cast("bigint")


def bucket_from(offset: Column, width: int) -> Column:
    """Bucket that holds ``offset`` when buckets are ``[k*width, (k+1)*width)``."""
    return F.floor(offset / F.lit(width))


def bucket_upto(offset: Column, width: int) -> Column:
    """Bucket that holds ``offset`` when buckets are ``(k*width, (k+1)*width]``."""
    return F.ceil(offset / F.lit(width)) - F.lit(1)


def clock_text(time: Column) -> Column:
    """``HH:MM`` of a timestamp without zone, whatever the session's zone."""
    return F.concat_ws(":", *[F.lpad(part(time).cast("string"), 2, "0") for part in (F.hour, F.minute)])
