"""Shape: first and last per group, ordered pivots, days side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group.

    Written as a filter on ``row_number`` so that Spark cuts every group down to one row
    before the shuffle (WindowGroupLimit) as well as after it.
    """
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_n") == 1).drop("_n")


def leading_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows that tie for first in each group (``rank`` = 1)."""
    ranked = df.withColumn("_n", F.rank().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_n") == 1).drop("_n")


def leading_wide(
    df: DataFrame, keys: list[str], kind: str, kinds: list[str], order: str, columns: dict[str, str]
) -> DataFrame:
    """The leading rows of each kind side by side, as ``columns`` (source: name with ``{}`` for the kind).

    Rows that tie for first are all kept: every combination of the kinds' leading rows is a
    row.  One ranking and one grouping serve all kinds; a list holds the ties of one kind.
    """
    leading = leading_rows(df, [*keys, kind], [F.col(order)])
    cell = F.struct(*columns)
    wide = leading.groupBy(*keys).agg(
        *[F.collect_list(F.when(F.col(kind) == k, cell)).alias(f"_{k}") for k in kinds]
    )
    for k in kinds:
        wide = wide.withColumn(f"_{k}", F.explode_outer(f"_{k}"))
    cells = [F.col(f"_{k}")[source].alias(name.format(k)) for k in kinds for source, name in columns.items()]
    return wide.select(*keys, *cells)


def first_value(value: str, order: list[str], name: str) -> Column:
    """Aggregate: ``value`` of the first row by ``order``, NULL keys last."""
    parts = []
    for column in order:
        parts += [F.col(column).isNull().alias(f"{column}_null"), F.col(column).alias(column)]
    return F.min_by(value, F.struct(*parts)).alias(name)


def ordered_pivot(
    df: DataFrame, key: str, order: list[Column], columns: list[str], count: int, same: Sequence[str] = ()
) -> DataFrame:
    """``<column>1 .. <column>count`` per key, in order; NULL past the end.

    Columns in ``same`` have one value per key and are kept as they are.

    Only the positions that become columns travel: rows past ``count`` are cut map-side
    and no list of a whole group is built.
    """
    placed = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    placed = placed.filter(F.col("_n") <= count)
    cells = [
        F.max(F.when(F.col("_n") == i, F.col(c))).alias(f"{c}{i}")
        for i in range(1, count + 1)
        for c in columns
    ]
    return placed.groupBy(key).agg(*cells, *[F.max(c).alias(c) for c in same])


def by_day(day: str, value: str, days: int, name: str) -> list[Column]:
    """Aggregates ``d1_<name> .. d<days>_<name>``: highest ``value`` where ``day`` is 0, 1, ..."""
    return [
        F.expr(f"max(case when {day} = {d} then {value} end) as d{d + 1}_{name}") for d in range(days)
    ]


def last_by_day(day: Column, order: str, value: str, days: int, name: str) -> list[Column]:
    """Aggregates: last non-NULL ``value`` of each day by ``order``."""
    place = F.struct(F.col(order), F.col(value))
    return [
        F.max_by(value, F.when((day == d) & F.col(value).isNotNull(), place)).alias(f"d{d + 1}_{name}")
        for d in range(days)
    ]


def greatest_day(days: int, name: str, label: str) -> Column:
    return F.greatest(*[F.col(f"d{d}_{name}") for d in range(1, days + 1)]).alias(label)


def total(columns: list[Column]) -> Column:
    """Sum of columns, NULL if any is NULL."""
    return reduce(lambda a, b: a + b, columns)
