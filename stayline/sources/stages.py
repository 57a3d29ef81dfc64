"""Materialised stages: written once, read back by every later step."""

from __future__ import annotations

from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir, or name a folder that all executors share")
    return named


def keep(_name: str, df: DataFrame) -> DataFrame:
    """Sink that writes nothing: the step stays part of the query."""
    return df


class Stages:
    """Overwriting table sink with read-back.

    A stage is a Parquet table in a shared folder.  It cuts the lineage, so the loss of an
    executor costs a re-read and not the run so far, and it tells the optimizer true sizes.
    ``drop`` removes helper stages once their results are written.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/stages-{uuid4().hex}"
        self.written: set[str] = set()

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.written.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but: Iterable[str] = ()) -> None:
        """Delete what this sink has written, except the stages named."""
        jvm = self.spark._jvm
        for name in self.written - set(but):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.written.discard(name)


class CatalogStages:
    """The same as managed tables of a database.

    Only ``public`` names are used as they are; every other stage gets a prefix of this run,
    so that runs do not collide and no table of the user's is overwritten.  With ``buckets``, tables that have
    the column ``key`` are bucketed and sorted by it, so that joins and groupings of stages on it need no shuffle;
    there should be at least as many buckets as shuffle partitions.
    """

    def __init__(
        self, spark: SparkSession, database: str, public: Iterable[str] = (), buckets: int = 0, key: str = "stay_id"
    ):
        self.spark, self.buckets, self.key = spark, buckets, key
        self.database = database
        self.public = set(public)
        self.prefix = f"run_{uuid4().hex}_"
        self.written: set[str] = set()

    def _table(self, name: str) -> str:
        return f"{self.database}.{name if name in self.public else self.prefix + name}"

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        if self.buckets and self.key in df.columns:
            # dealt as the buckets are, every task writes one file
            rows = df.repartition(self.buckets, self.key)
            writer = rows.write.bucketBy(self.buckets, self.key).sortBy(self.key)
        else:
            writer = df.write
        writer.mode("overwrite").saveAsTable(self._table(name))
        self.written.add(name)
        return self.spark.table(self._table(name))

    def drop(self, but: Iterable[str] = ()) -> None:
        """Drop this run's tables, except the stages named."""
        for name in self.written - set(but):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            self.written.discard(name)
