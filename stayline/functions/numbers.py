"""Numbers: amounts and rates as double, and the two ways of rounding them.

Sums of doubles depend in the last bits on the order in which partitions arrive.  Values
are therefore brought to a fixed number of decimals before they are rounded, so that an
exact half is seen as one whatever the order, also after a task had to run again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT_DIGITS = 6
RATE_DIGITS = 9


def numeric(value: Column) -> Column:
    return value.cast("double")


def numeric_text(value: Column) -> Column:
    """Free text as number; NULL where the text is none."""
    return value.try_cast("double")


def clean(value: Column, digits: int = AMOUNT_DIGITS) -> Column:
    """Nearest double with ``digits`` decimals."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def whole(value: Column) -> Column:
    """To a whole number, halves away from zero."""
    value = clean(value)
    return F.when(value < 0, F.ceil(value - 0.5)).otherwise(F.floor(value + 0.5))


def whole_even(value: Column) -> Column:
    """To a whole number, halves to the even neighbour."""
    return F.rint(clean(value)).cast("bigint")


def decimals(value: Column, places: int) -> Column:
    """A rate to ``places`` decimals, halves away from zero."""
    return F.round(clean(value, RATE_DIGITS), places)


def sixtieths(value: Column) -> Column:
    """A total kept in rate-minutes (amount x 60) back to the amount."""
    return value / F.lit(60.0)


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))
