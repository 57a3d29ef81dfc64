"""Bedside echo procedures: one row per examination, then one row per stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.clinical import offset_of
from ..operators.grid import with_length
from ..operators.shape import ordered_pivot

GAP = 60
COLUMNS = ["tte_offset", "tte_start", "tte_end", "tte_store"]


def charted(procedureevents: DataFrame, stays: DataFrame, item: int = codes.ECHO_ITEM) -> DataFrame:
    """Procedures of one kind that began before the end of the stay."""
    return (
        procedureevents.filter(F.col("itemid") == item)
        .join(with_length(stays), "stay_id")
        .withColumn("tte_offset", offset_of("starttime"))
        .filter(F.col("tte_offset") < F.col("los_min"))
        .select(
            "stay_id",
            "tte_offset",
            F.col("starttime").alias("tte_start"),
            F.col("endtime").alias("tte_end"),
            F.col("storetime").alias("tte_store"),
        )
    )


def deduplicated(rows: DataFrame, gap: int = GAP) -> DataFrame:
    """Rows at the first start time, and later ones more than ``gap`` minutes after the row before.

    The row before is any charted one, kept or not, so a chain of close entries counts once.
    Adds the rank ``rn`` within the stay; rows that tie for the first start share rank 1.

    A row with a gap before it is the earliest of its minute, and the first start is in the first
    minute.  So each minute is reduced to the rows that share its earliest start: they are dealt once by stay
    and minute, and the window sees one row per minute of the stay.
    """
    dealt = rows.repartition("stay_id", "tte_offset")
    starts = dealt.groupBy("stay_id", "tte_offset", "tte_start").agg(
        F.collect_list(F.struct("tte_end", "tte_store")).alias("ties")
    )
    minutes = starts.groupBy("stay_id", "tte_offset").agg(
        F.min("tte_start").alias("tte_start"), F.min_by("ties", "tte_start").alias("ties")
    )
    along = Window.partitionBy("stay_id").orderBy("tte_offset")
    before = F.lag("tte_offset").over(along)
    placed = minutes.withColumns(
        {
            "_opens": before.isNull(),
            "_later": F.when(F.col("tte_offset") - before > gap, 1).otherwise(0),
            "_openings": F.first(F.size("ties")).over(along),
        }
    )
    rank = F.when(F.col("_opens"), 1).otherwise(F.sum("_later").over(along) + F.col("_openings"))
    kept = F.when(F.col("_opens"), F.col("ties")).otherwise(F.array(F.array_min("ties")))
    return (
        placed.withColumn("rn", rank.cast("bigint"))
        .filter(F.col("_opens") | (F.col("_later") == 1))
        .select("stay_id", "tte_offset", "tte_start", F.inline(kept), "rn")
    )


def table(rows: DataFrame, count: int = 15) -> DataFrame:
    """One row per stay: up to ``count`` procedures side by side and the number of them."""
    order = [F.col(c).asc_nulls_first() for c in COLUMNS]
    numbered = rows.withColumn("tte_number", F.max("rn").over(Window.partitionBy("stay_id")))
    return ordered_pivot(numbered, "stay_id", order, COLUMNS, count, ["tte_number"])


def per_stay(procedureevents: DataFrame, stays: DataFrame, count: int = 15) -> DataFrame:
    """The whole chain, in one pass over both tables."""
    return table(deduplicated(charted(procedureevents, stays)), count)
