"""Proportional stratified interleaving: every shard has the mixture of the whole.

Rows are put in a seeded random order within their stratum; the row at place r of n has the fraction
(r + 1/2) / n; all rows are ordered by fraction and cut into shards of equal numbers of rows.  Any run of that
order, and so any shard, holds of each stratum its share to within one row or two.

Both orders are global and neither gathers a stratum: ranks come from numbered buckets of hashes or
fractions and the counts before them.  Built-in expressions only.

Defined cases: a null stratum is one of its own; a null id is hashed like a value; repeated rows keep all
their rows, in any order among themselves; other columns are kept, but for those named shard and slot; an
empty table gives an empty one; with fewer rows than shards, some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, staged

#: Rows that a bucket holds on average.
BUCKET_ROWS = 50_000


def sharded(rows: DataFrame, stratum: str, shards: int, seed: int) -> DataFrame:
    """``rows`` (doc_id, ``stratum``, any others, preferably no texts) with shard and slot in the shard."""
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    plain = [f"c{i}" for i in range(len(columns))]
    own = [F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain, strict=True)]
    rows = rows.select(
        *own,
        F.col(stratum).isNull().alias("_none"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"),
        F.xxhash64(F.lit(seed), "doc_id").alias("_hash"),
    )
    rows = staged(rows, "rows")
    bits = max(4, (rows.count() // BUCKET_ROWS).bit_length())
    drawn = F.shiftright("_hash", 64 - bits)
    rows = ranked(rows, ["_none", "_stratum"], ["_hash", *plain], drawn, "_place", "_of")
    # a product with a power of two is exact, so buckets and fractions ascend together
    rows = rows.withColumn("_fraction", (2 * F.col("_place") + 1) / (2.0 * F.col("_of")))
    order = ["_fraction", "_none", "_stratum", "_place"]
    rows = ranked(rows, [], order, F.floor(F.col("_fraction") * (1 << bits)), "_at", "_rows")
    shard = F.expr(f"_at * {shards} div _rows")
    first = F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
    back = [F.col(p).alias(c) for c, p in zip(columns, plain, strict=True)]
    return rows.withColumn("shard", shard).withColumn("slot", F.col("_at") - first).select(
        *back, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")
    )


def write(sharded_rows: DataFrame, folder: str) -> None:
    """One folder per shard, its rows in order of slot; a shard is written by as many tasks as it needs."""
    ordered = sharded_rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(folder)
