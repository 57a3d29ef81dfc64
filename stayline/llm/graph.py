"""Connected components of a table of links, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every neighbour above a node on the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its neighbours below it on the smallest of them; ``links`` point down."""
    own = _smallest(links)
    lower = links.join(own, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.union(own.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links``: distinct pairs u > v.  Rows (u, v): every linked node but a root, and its component's
    smallest node.  Each round is written to the shared folder, so it survives lost executors and the
    plan stays short; the number of rounds grows with the logarithm of the longest chain.
    """
    links = staged(links, "links")
    state = _state(links)
    while True:
        links = staged(_small_star(_large_star(links)), "links")
        if (new := _state(links)) == state:
            return links
        state = new
