"""Near-duplicates by 64-bit SimHash fingerprints, linked at three or fewer differing bits.

Deletion variants: a fingerprint is cut into two halves; of two fingerprints that differ in at most
three bits, one half differs in at most one.  So each half is indexed as it is and with every single bit
wiped out, equal keys are joined, and the pairs are verified.  Halves that are equal meet under the
exact key only, halves that differ in one bit under that bit's key only.

A key that more than ``BUCKET`` fingerprints share is not paired up: its fingerprints are indexed again
on the undecided half, cut in two in the same way, and so on; the last cut leaves so few free bits that a
bucket cannot be large.  No link is lost.  Keys are counted by a grouping and the counts joined back, so no task
holds all of a hot key.

Defined cases: a null, empty or wordless text has the fingerprint 0, which links like any other; equal
fingerprints are one node, so copies are never paired; repeated rows keep all their rows; a null id
belongs to its component but does not name it (``component_id`` is null only if no id of it is known);
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .graph import components

#: Bits that linked fingerprints may differ in.  The halving above is right for up to three.
RADIUS = 3
#: Fingerprints under one key that are still paired up.
BUCKET = 256
SHINGLE = 3
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < size:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):  # memory stays bounded for any length of text
        part = [hashed(next(shingles), SEED) for _ in range(min(65536, n - at))]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """doc_id, fp; _text_hash, 64 bits of the text as it is, if ``hashed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text) for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "fp", "_text_hash"] if hashed else ["doc_id", "fp"]
    more = [_text_hash()] if hashed else []
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *more)
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _text_hash() -> Column:
    return F.xxhash64(F.col("text"), F.col("text").isNull()).alias("_text_hash")


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """Index rows (fp, bucket, base) on the ``width`` undecided bits from bit ``base`` up.

    Adds bit (the value of the bit wiped out, 2 under the exact key); the half not matched on is
    undecided next.
    """
    half = width // 2
    choices = half + 1
    rows = rows.withColumn("choice", F.explode(F.sequence(F.lit(0), F.lit(2 * choices - 1))))
    pos = F.col("choice") % choices
    upper = F.col("choice") < choices
    shift = F.col("base") + F.when(upper, half).otherwise(0)
    segment = F.expr("shiftrightunsigned(fp, shift)").bitwiseAND(F.lit((1 << half) - 1))
    rows = rows.withColumn("shift", shift).withColumn("pos", pos).withColumn("segment", segment)
    wiped = F.when(
        F.col("pos") < half,
        F.col("segment").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, pos)"))),
    ).otherwise(F.col("segment"))
    bit = F.when(F.col("pos") < half, F.expr("shiftright(segment, pos)").bitwiseAND(F.lit(1))).otherwise(2)
    key = F.expr(f"shiftleft(cast(choice as long), {half})").bitwiseOR(wiped)
    if width < 64:  # a clash of these hashes brings a pair more to verify, never one less
        key = F.xxhash64("bucket", key)
    return rows.select(
        "fp",
        key.alias("bucket"),
        F.when(upper, F.col("base")).otherwise(F.col("base") + half).cast("int").alias("base"),
        bit.cast("tinyint").alias("bit"),
    )


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct pairs u > v of the distinct fingerprints ``fps`` (fp) within ``RADIUS`` bits."""
    rows = fps.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("base"))
    found = []
    for width in (64, 32, 16, 8):
        variants = _variants(rows, width)
        counts = variants.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        # files of such rows are a hundredth of their size in memory, so no side is broadcast by it; the counts, one
        # row a key, spread evenly and are hashed, which spares the variants a sort
        shared = staged(variants.join(staged(counts, "counts").hint("shuffle_hash"), "bucket"), "shared")
        last = width == 8
        few = shared if last else shared.filter(F.col("n") <= bucket)
        a, b = few.alias("a"), few.alias("b").hint("merge")
        met = F.expr("a.bucket = b.bucket AND a.fp > b.fp AND (a.bit = 2 OR a.bit <> b.bit)")
        near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
        found.append(a.join(b, met).filter(near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")))
        if last:
            break
        many = shared.filter(F.col("n") > bucket)
        if many.isEmpty():
            break
        rows = many.select("fp", "bucket", "base").distinct()
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def _members(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """The rows of ``fingerprints`` with root (the component's smallest fingerprint) and component_id."""
    fps = staged(fingerprints(docs, hashed), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    nodes = nodes.select("fp", "root").join(names, "root").select("fp", "root", "component_id")
    return fps.join(nodes, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable)."""
    return _members(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest id, then the smallest text hash; rows without an id
    have no order and stay.
    """
    named = _members(docs, hashed=True).filter(F.col("doc_id") == F.col("component_id"))
    texts = named.groupBy("root", "doc_id", "_text_hash").agg(F.count(F.lit(1)).alias("_n"))
    least = texts.groupBy("root").agg(F.min(F.struct("_text_hash", "doc_id", "_n")).alias("least")).select("least.*")
    first = staged(least, "first").hint("shuffle_hash")  # whole texts are neither sorted for this nor grouped
    rows = docs.withColumn("_text_hash", _text_hash()).join(first, ["doc_id", "_text_hash"])
    again = rows.filter("_n > 1").dropDuplicates(["doc_id", "_text_hash"])
    rows = rows.filter("_n = 1").unionByName(again).select(docs.columns)
    return rows.unionByName(docs.filter("doc_id IS NULL"))
