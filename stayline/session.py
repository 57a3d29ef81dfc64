"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# One stay may hold a large share of all rows.  Adaptive execution splits such a
# partition of a join; "force" lets it do so even where the grouping after the join
# must then be shuffled once more.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Switch on adaptive skew handling; sizes and partition counts stay the cluster's."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark
