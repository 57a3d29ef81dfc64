"""What the operators share: the cluster's shared folder, staged tables, words, distributed ranks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

import numpy as np
import zstandard
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words; everything else belongs to a word.
SPACES = r"[\x20\x09-\x0D]+"


@lru_cache(maxsize=4)
def _ship(context: SparkContext) -> None:
    """Send this package's sources to the executors, whose Python need not know the repository."""
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="llm-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(path)


@lru_cache(maxsize=4)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of its own only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _own_folder(spark.sparkContext.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: it is computed once and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """``staged`` as a table bucketed by ``key``: grouped or joined on it later, its rows need no shuffle."""
    spark = df.sparkSession
    table_name = f"llm_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", scratch(spark, name)).saveAsTable(table_name)
    return spark.table(table_name)


def packed(numbers: np.ndarray) -> bytes:
    """Integers as bytes, byte by byte: the high ones are mostly 0."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> SparkSession:
    """Whole texts go to Python in batches bounded by rows and bytes; executors get the package."""
    _ship(spark.sparkContext)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, rank: str, total: str | None = None
) -> DataFrame:
    """Add ``rank``: each row's position from 0 among the rows of its ``keys`` by ``order``, and ``total``, their number.

    ``bucket`` is any non-decreasing function of ``order`` with enough values to spread a hot key: rows
    are numbered inside (keys, bucket), and one row per bucket carries the count before it.  ``keys`` must
    not be null.
    """
    df = df.withColumn("_bucket", bucket)
    group = [*keys, "_bucket"]
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.select(
        *group, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("_all")
    )
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    out = df.withColumn("_inside", inside).join(counts, group)
    out = out.withColumn(rank, (F.col("_before") + F.col("_inside")).cast("long"))
    out = out.withColumn(total, F.col("_all")) if total else out
    return out.drop("_bucket", "_inside", "_before", "_all")
