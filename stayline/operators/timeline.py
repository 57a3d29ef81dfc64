"""Order along a stay: previous and next row, running totals, episodes.

A window over a whole stay puts the stay into one task.  That is safe only where the
number of rows is bounded by time and not by how much was charted, so rows are first
reduced to one per minute or hour, or the neighbours are found in two steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(
    df: DataFrame,
    key: str | list[str],
    order: str,
    chunk: Column,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """Add columns of the previous and the next row of each ``key`` by ``order``.

    Step one looks within a time chunk of the stay, so a stay with very many rows is spread
    over its chunks.  Only the first and last row of a chunk lack a neighbour; step two
    gives them one by a window over just these edge rows, at most two per chunk.
    ``order`` must be unique within a key.  ``chunk`` must not decrease with ``order``.
    """
    previous, following = previous or {}, following or {}
    keys = [key] if isinstance(key, str) else key
    by_order = F.col(order).asc_nulls_last()
    local = Window.partitionBy(*keys, "_chunk").orderBy(by_order)
    df = df.withColumn("_chunk", chunk)
    df = df.withColumns(
        {"_has_prev": F.lag(F.lit(1)).over(local), "_has_next": F.lead(F.lit(1)).over(local)}
        | {f"_p_{n}": F.lag(c).over(local) for n, c in previous.items()}
        | {f"_n_{n}": F.lead(c).over(local) for n, c in following.items()}
    )
    edge = F.col("_has_prev").isNull() | F.col("_has_next").isNull()
    df = df.withColumn("_edge", edge)
    # inner rows keep their chunk as group; edge rows share the group NULL
    df = df.withColumn("_group", F.when(~F.col("_edge"), F.col("_chunk")))
    across = Window.partitionBy(*keys, "_group").orderBy(by_order)
    columns = {}
    for name, source in previous.items():
        columns[name] = F.when(
            F.col("_has_prev").isNull(), F.lag(source).over(across)
        ).otherwise(F.col(f"_p_{name}"))
    for name, source in following.items():
        columns[name] = F.when(
            F.col("_has_next").isNull(), F.lead(source).over(across)
        ).otherwise(F.col(f"_n_{name}"))
    helpers = ["_chunk", "_has_prev", "_has_next", "_edge", "_group"]
    helpers += [f"_p_{n}" for n in previous] + [f"_n_{n}" for n in following]
    return df.withColumns(columns).drop(*helpers)


def running_sum(column: Column, key: str, order: str) -> Column:
    """Total from the first row of ``key`` to this one.

    For frames with one row per ``key`` and ``order`` step, such as an hourly grid: their
    length is the stay's, whatever was charted in it.
    """
    frame = (
        Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.sum(column).over(frame)


def episode_flags(
    df: DataFrame, key: str | list[str], order: str, begin: str, end: str, gap: int = 60
) -> DataFrame:
    """Mark rows that open (``change = 'start'``) and close (``is_end = 1``) an episode.

    A row opens one if nothing came before it or more than ``gap`` minutes passed since the
    previous end; it closes one if nothing follows or the next begins more than ``gap`` later.
    ``begin`` is the offset of ``order`` in minutes.
    """
    df = with_neighbours(
        df.withColumn("_one", F.lit(1)),
        key,
        order,
        F.floor(F.col(begin) / 60),
        previous={"_prev_row": "_one", "_prev_end": end},
        following={"_next_begin": begin},
    )
    opens = F.col("_prev_row").isNull() | (F.col(begin) > F.col("_prev_end") + gap)
    closes = F.col("_next_begin").isNull() | (F.col(end) + gap < F.col("_next_begin"))
    return (
        df.withColumn("change", F.when(opens, "start"))
        .withColumn("is_end", F.when(closes, 1).otherwise(0))
        .drop("_one", "_prev_row", "_prev_end", "_next_begin")
    )


def change_within(low: Column, high: Column, begin: str = "begin_offset", end: str = "end_offset") -> Column:
    """What an episode does in ``[low, high)``: its ``change``, ``stop``, or NULL for nothing.

    An episode that already runs at ``low`` can only stop, and may do so at ``high`` itself;
    any other can only start.
    """
    running = F.col(begin) < low
    at = F.when(running, F.col(end)).otherwise(F.col(begin))
    inside = (at >= low) & ((at < high) | (running & (at == high)))
    stop = F.when(F.col("is_end") == 1, "stop")
    return F.when(inside, F.when(running, stop).otherwise(F.col("change")))
