"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

``write`` deals the documents out by ranges of their id, so that files, stripes and rows ascend by id;
each file carries the place of every document in its own stream.  ``read`` gives back documents with
their place in the whole stream, stripe by stripe; ``lookup`` reads only stripes whose Bloom filters,
minima and maxima admit the ids asked for.

Defined cases: a null text has no tokens of its own, only the end id; a null id comes first; rows with
one id keep all their rows, in the order of their texts' hashes; other columns are ignored; an empty
table gives an empty one.  Ids must fit 31 bits, as ORC integers are signed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .wordpiece import encoder

SCHEMA = "doc_id long, n_tokens long, place long, ids array<int>"


def write(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    stripe_bytes: int = 32 << 20,
    index_rows: int = 1000,
) -> None:
    """Encode ``docs`` (doc_id, text) and write one ORC file per range of ids."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary).encode_all
        end = np.array([end_id], "<u4").tobytes()
        place = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [ids + end for ids in ids_of(batch.column(1).to_pylist())]
            lengths = np.array([len(x) // 4 for x in found])
            ends = np.cumsum(lengths)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]), pa.int32()),
                pa.array(np.frombuffer(b"".join(found), "<i4")),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths), pa.array(place + ends - lengths), lists],
                ["doc_id", "n_tokens", "place", "ids"],
            )
            place += int(ends[-1])

    (
        rows.mapInArrow(encode, SCHEMA)
        .write.option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("compression", "zstd")
        .orc(folder)
    )


def _files(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(SCHEMA).orc(folder)
    return rows.withColumn("file", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"))


def _with_start(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Add the number of ids in all files before to each place.

    The broadcast side has one short row per file of the folder, fewer than the file listing the
    driver holds to plan the scan; of the ids themselves only their counts are read for it.
    """
    totals = _files(spark, folder).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(base), "file")
    return joined.withColumn("start", F.col("base") + F.col("place")).drop("base", "place", "file")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids, start: all documents, read in parallel by stripes."""
    return _with_start(_files(spark, folder), spark, folder)


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The named documents only; the filter reaches the stripes' statistics and Bloom filters."""
    return _with_start(_files(spark, folder).filter(F.col("doc_id").isin(doc_ids)), spark, folder)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, computed from the ids in the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            offsets = ids.offsets.to_numpy().tolist()
            values = ids.values.to_numpy().astype("<i4", copy=False)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            counted = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), counted, pa.array(sums, pa.int64()), batch.column(4)],
                ["doc_id", "place", "n_tokens", "ids_crc32", "file"],
            )

    rows = _files(spark, folder).select("doc_id", "place", "n_tokens", "ids", "file")
    short = rows.mapInArrow(crc, "doc_id long, place long, n_tokens long, ids_crc32 long, file long")
    return _with_start(short, spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
