"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Bins are filled greedily with the longest piece that fits; then the bin's smallest piece is exchanged
for two unpacked pieces that fit the gap it leaves more tightly.  Pieces of one length are alike, so the
bins are planned on the number of pieces of every length: a filled bin is repeated as long as the
lengths it uses last, which gives the same bins as filling them one by one.  The plan's size depends on
the capacity alone, not on the data.  Every piece then finds its place by its rank among the pieces of
its length.

Defined cases: a null or empty text is one piece that holds the end id; a null id is kept like any
other; repeated rows are packed once each; other columns are ignored (``pack`` keeps all it is given); an
empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked
from .wordpiece import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, ids: bool = False) -> DataFrame:
    """Encode documents, append the end id, cut those over ``capacity``; ``ids`` adds the pieces' ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary).encode_all
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, parts = [], []
            for doc_id, ids_found in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
                stream = ids_found + end
                for piece, at in enumerate(range(0, len(stream), 4 * capacity)):
                    part = stream[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if ids:
                        parts.append(np.frombuffer(part, "<i4"))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if ids else ""))


def _fill(free: np.ndarray, capacity: int) -> list[int]:
    """The lengths of one bin, taken from the pieces left."""
    free = free.copy()
    lengths = np.arange(len(free))

    def longest() -> np.ndarray:
        """For every gap, the longest length left that fits it; 0 if none does."""
        return np.maximum.accumulate(np.where(free > 0, lengths, 0))

    fits, gap, filled = longest(), capacity, []
    while length := int(fits[gap]):
        take = min(int(free[length]), gap // length)
        filled += [length] * take
        free[length] -= take
        gap -= take * length
        if not free[length]:
            fits = longest()
    if gap and len(filled) > 1:
        smallest = filled[-1]
        room = gap + smallest
        first = np.flatnonzero(free[: room + 1] > 0)
        second = fits[room - first]
        lone = (second == first) & (free[first] < 2)
        second = np.where(lone, fits[np.maximum(first - 1, 0)], second)
        both = np.where(second > 0, first + second, 0)
        if both.size and both.max() > smallest:
            best = int(both.argmax())
            filled[-1:] = [int(first[best]), int(second[best])]
    return filled


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many, {length: pieces of it in each}); ``counts``: pieces of every length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while left.any():
        lengths, each = np.unique(_fill(left, capacity), return_counts=True)
        times = int((left[lengths] // each).min())
        left[lengths] -= times * each
        bins.append((times, dict(zip(lengths.tolist(), each.tolist(), strict=True))))
    return bins


def _places(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces in each bin, first bin, offset), by length and rank."""
    rows, used, base = [], {}, 0
    for times, each in bins:
        offset = 0
        for length, n in each.items():
            rows.append((length, used.get(length, 0), n, base, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * n
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to ``rows``, which have doc_id, piece and length from 1 to ``capacity``.

    ``rows`` is read twice, so hand over a table that is written.
    """
    # at most ``capacity`` rows come to the driver
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    places = _places(plan(counts, capacity))
    keys = (places[:, 0] << 44) + places[:, 1]

    columns = rows.columns
    order = ["_hash", "doc_id", "piece", *[c for c in columns if c not in ("doc_id", "piece")]]
    hashed = rows.withColumn("_hash", F.xxhash64("doc_id", "piece"))
    spread = F.shiftright("_hash", 54)
    numbered = ranked(hashed, ["length"], order, spread, "_rank").select(*columns, "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(columns.index("length")).to_numpy().astype(np.int64)
            rank = batch.column(len(columns)).to_numpy()
            at = places[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - at[:, 1]
            sequence, offset = at[:, 3] + nth // at[:, 2], at[:, 4] + nth % at[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                [*columns, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences (sequence_id, ids) of packed pieces that carry their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
