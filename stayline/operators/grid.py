"""Regular grids along a stay, and the buckets a point or an interval falls into.

Every range join of "series x grid" becomes arithmetic on the offset: the bucket numbers
are computed on the row, so the later join or grouping is on equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import BLOCK, bucket_from, minutes_between, rounded_units

BLOCK_LIMIT = 5 * 1440


def with_length(stays: DataFrame) -> DataFrame:
    """``stay_id, intime_hr, los_min``: one row per stay with its length in minutes."""
    return stays.select(
        "stay_id",
        "intime_hr",
        minutes_between(F.col("intime_hr"), F.col("outtime_hr")).alias("los_min"),
    )


def spread(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per whole number in ``first..last``; rows without any are dropped.

    The guard matters: ``sequence`` counts backwards when the last is below the first.
    """
    return (
        df.withColumn("_first", first.cast("bigint"))
        .withColumn("_last", last.cast("bigint"))
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn(name, F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by ``key`` over all shuffle partitions, also where adaptive execution would join them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def hour_grid(lengths: DataFrame) -> DataFrame:
    """``stay_id, hr`` for hours 0 to the rounded length of stay."""
    return spread(lengths, F.lit(0), rounded_units(F.col("los_min"), 60), "hr").select(
        "stay_id", "hr"
    )


def every_hour(known: DataFrame, lasts: DataFrame) -> DataFrame:
    """``known``, unique by ``stay_id, hr``, and a row of zeros for every other hour of the stay.

    ``lasts`` is ``stay_id, last``: the last minute of the grid; of several rows the highest counts,
    and it comes back as ``last``.  The hours nothing is known about are neither shuffled nor grouped:
    each stay's hours meet its last minute in a list, bounded by its length, and the others are
    made on the way out.
    """
    values = [c for c in known.columns if c not in ("stay_id", "hr")]
    row = F.struct("hr", *values).alias("row")
    stays = known.select("stay_id", F.lit(None).cast("bigint").alias("last"), row).unionByName(
        lasts.select("stay_id", F.col("last").cast("bigint").alias("last")), allowMissingColumns=True
    )
    stays = stays.groupBy("stay_id").agg(F.max("last").alias("last"), F.collect_list("row").alias("rows"))
    hours = F.when(F.col("last") >= 0, F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / 60)))
    hours = F.coalesce(hours, F.array().cast("array<bigint>"))
    others = F.array_except(hours, F.transform("rows", lambda r: r["hr"]))
    zeros = F.transform(others, lambda h: F.struct(h.alias("hr"), *[F.lit(0.0).alias(c) for c in values]))
    return stays.select("stay_id", "last", F.inline(F.concat("rows", zeros)))


# --- 4-hour blocks: block 0 is [-240, 60), block b > 0 is [240b - 240, 240b) --------

def block_start(block: Column) -> Column:
    return block * BLOCK - BLOCK


def block_end(block: Column) -> Column:
    return F.when(block == 0, F.lit(60).cast("bigint")).otherwise(block * BLOCK)


def last_block(los: Column, limit: int = BLOCK_LIMIT) -> Column:
    """Highest block of a stay: the rounded length, and starting before ``limit``."""
    highest = F.lit((limit - 1 + BLOCK) // BLOCK)
    # least() skips NULL, and a stay of unknown length has no grid
    return F.when(los.isNotNull(), F.least(rounded_units(los, BLOCK), highest))


def block_grid(lengths: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """``stay_id, block, minute_start, minute_end``."""
    return spread(lengths, F.lit(0), last_block(F.col("los_min"), limit), "block").select(
        "stay_id",
        "block",
        block_start(F.col("block")).alias("minute_start"),
        block_end(F.col("block")).alias("minute_end"),
    )


def into_blocks(df: DataFrame, candidates: list[Column], keep: Column) -> DataFrame:
    """One row per (row, block) for which ``keep`` holds.

    ``candidates`` are the few block numbers arithmetic allows for a row; ``keep`` is the
    exact condition on ``block``, ``minute_start`` and ``minute_end``.
    """
    numbers = F.array_distinct(F.array_compact(F.array(*[c.cast("bigint") for c in candidates])))
    return (
        df.withColumn("block", F.explode(numbers))
        .filter(F.col("block") >= 0)
        .withColumn("minute_start", block_start(F.col("block")))
        .withColumn("minute_end", block_end(F.col("block")))
        .filter(keep)
    )


def points_into_blocks(df: DataFrame, offset: Column) -> DataFrame:
    """Blocks whose ``[start, end)`` holds ``offset``: one, or two where 0 and 1 overlap."""
    inside = (F.col("minute_start") <= offset) & (offset < F.col("minute_end"))
    return into_blocks(df, [bucket_from(offset, BLOCK) + 1, F.lit(0)], inside)


def intervals_into_blocks(df: DataFrame, start: Column, end: Column, limit: int = BLOCK_LIMIT):
    """Blocks that an interval with closed end touches: ``end >= block start, start < block end``."""
    # block 0 reaches back to -240 and on to 60, so it is a candidate of its own
    first = F.greatest(bucket_from(start, BLOCK) + 1, F.lit(1))
    last = F.least(bucket_from(end, BLOCK) + 1, F.lit((limit - 1 + BLOCK) // BLOCK))
    later = F.when(first <= last, F.sequence(first, last))
    block_0 = F.when((end >= -BLOCK) & (start < 60), F.array(F.lit(0).cast("bigint")))
    none = F.array().cast("array<bigint>")
    numbers = F.concat(F.coalesce(block_0, none), F.coalesce(later, none))
    known = df.filter(start.isNotNull() & end.isNotNull())
    return known.withColumn("block", F.explode(numbers))
