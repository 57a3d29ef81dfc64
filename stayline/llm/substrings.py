"""Removal of word windows that also start earlier, with a count-min prefilter.

1. The table is kept as chunks of about ``CHUNK`` bytes of text, bucketed by chunk, so that no later step shuffles
   a text.  Every chunk puts its windows into a count-min sketch (``ROWS`` rows of cells).  The sketches are merged block by
   block, a block being a range of cells; each chunk gets back one bit for every cell it has hit: hit once in all, or more often.
   A window's count is never underestimated.
2. A second pass keeps only windows whose cells were all hit more often.  Within a chunk all but the first
   occurrence are decided at once; the first ones, with a 96-bit hash of their words, are grouped
   exactly by hash, so a window that a third of all documents share comes once per chunk.
3. The starts found go back to their chunks, and the covered words go.

The sketch has four cells in a row for each window, at any size: no task and not the driver holds it whole, and the
text is hashed twice whatever its length.

Defined cases: a null, empty or short text loses nothing; a null id counts as the smallest; rows with one
id are ordered by their texts' hashes, and equal rows are one document (both lose the same); a very long text is
hashed in parts, and stays whole in a chunk of its own size; bytes that are no UTF-8 are parts of words like all others, and
stay; other columns are kept by ``deduplicated``, but for those named like the ones it adds, and ignored by
``removed``; an empty table gives an empty one.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, staged_by, unpacked

WINDOW = 20
ROWS = 2
#: Cells in a block, the unit in which sketches are merged.
BLOCK = 1 << 24
#: Bytes of text in a chunk.
CHUNK = 8_000_000
#: Words that a task hashes at once.
AT_ONCE = 400_000
#: Windows of the text for each bucket of candidates.
BLOCK_WINDOWS = 5_000_000
#: Distinct words a worker remembers the hashes of.
KEPT = 500_000


class WordHashes(dict):
    """Places of words in two arrays of 64-bit hashes."""

    def __init__(self):
        self.low, self.high = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_128_intdigest(word)
        self.low.append(value & (1 << 64) - 1)
        self.high.append(value >> 64)
        self[word] = place = len(self.low) - 1
        return place

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > KEPT:
            self.clear()
            self.low, self.high = array("Q"), array("Q")
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.low, np.uint64)[at], np.frombuffer(self.high, np.uint64)[at]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` elements, from those of runs of 1, 2, 4, ... elements."""
    run, length, out, covered = hashes, 1, None, 0
    while True:
        if size & length:
            n = len(hashes) - size + 1
            part = run[covered : covered + n]
            out = part if out is None else _joined(out, part)
            covered += length
        if length * 2 > size:
            return out
        run = _joined(run[:-length], run[length:])
        length *= 2


def _groups(texts: list[bytes | None], size: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, each with its first place, and their words, about ``AT_ONCE`` words together; longer texts are cut."""
    rows, places, counts, words = [], [], [], []
    for row, text in enumerate(texts):
        own = text.split() if text else []
        for at in range(0, len(own) - size + 1, AT_ONCE):
            part = own[at : at + AT_ONCE + size - 1] if len(own) > AT_ONCE else own
            rows.append(row)
            places.append(at)
            counts.append(len(part))
            words += part
            if len(words) >= AT_ONCE:
                yield rows, places, counts, words
                rows, places, counts, words = [], [], [], []
    if words:
        yield rows, places, counts, words


def _windows(texts: list[bytes | None], known: WordHashes, size: int) -> Iterator[tuple]:
    """Windows as (row, start, two hashes, which are true: those that do not reach into the next text)."""
    for rows, places, counts, words in _groups(texts, size):
        low, high = known.of(words)
        counts = np.array(counts)
        of = np.repeat(np.arange(len(rows)), counts)[: len(words) - size + 1]
        at = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
        true = at + size <= counts[of]
        yield np.array(rows)[of], at + np.array(places)[of], _rolled(low, size), _rolled(high, size), true


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _hashed(texts: list[bytes | None], size: int) -> tuple[np.ndarray, ...]:
    """row, start and two hashes of every window."""
    known, found = WordHashes(), []
    for row, at, low, high, true in _windows(texts, known, size):
        found.append((row[true], at[true], low[true], high[true]))
    kinds = (np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.empty(0, k) for k in kinds)


class Sketch:
    """The cells that a chunk's windows hit: of each row those hit, in order, and which of them a window hits."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int):
        self.hit, self.more, self.of = [], [], []
        for hashes in (low, high):
            hit, of, counts = np.unique(hashes % np.uint64(cells), return_inverse=True, return_counts=True)
            self.hit.append(hit.astype(np.int64))
            self.more.append(counts > 1)
            self.of.append(of)
        self.edges = np.arange(0, cells + BLOCK, BLOCK)

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks in order, the cells hit there, and which of them more than once."""
        for row, (hit, more) in enumerate(zip(self.hit, self.more, strict=True)):
            cuts = np.searchsorted(hit, self.edges).tolist()
            for block, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    yield row * len(cuts) + block, hit[a:b] - self.edges[block], more[a:b]

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which windows have only cells that the corpus hits more than once."""
        bits = [np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(hit)) for b, hit, _ in self.blocks()]
        flat, at = np.concatenate(bits) if bits else np.empty(0, np.uint8), 0
        out = np.ones(len(self.of[0]), bool)
        for hit, of in zip(self.hit, self.of, strict=True):
            out &= flat[at : at + len(hit)][of] == 1
            at += len(hit)
        return out


PARTS = "block long, chunk long, cells binary, more binary"
ANSWERS = "block long, chunk long, bits binary"


def _sketches(chunks: DataFrame, size: int, cells: int) -> DataFrame:
    """Rows of ``PARTS``: the cells of a block that a chunk has hit, and which of them more than once."""
    kinds, names = [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["block", "chunk", "cells", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, _, low, high = _hashed(texts, size)
                rows = []
                for block, hit, more in Sketch(low, high, cells).blocks():
                    steps = np.diff(hit, prepend=0).astype(np.uint32)
                    rows.append((block, chunk, packed(steps), np.packbits(more).tobytes()))
                yield _batch(names, kinds, rows)

    return chunks.select("chunk", "whole").mapInArrow(run, PARTS)


def _answers(sketches: DataFrame) -> DataFrame:
    """Rows of ``ANSWERS``: for each cell that a chunk has hit, in order, whether all chunks hit it more than once."""

    def merge(table: pa.Table) -> pa.Table:
        block, chunks = table.column("block")[0].as_py(), table.column("chunk").to_pylist()
        count, hits = np.zeros(BLOCK, np.uint8), table.column("cells").to_pylist()
        for cells, more in zip(hits, table.column("more").to_pylist(), strict=True):
            hit = np.cumsum(unpacked(cells, np.uint32))
            again = np.unpackbits(np.frombuffer(more, np.uint8), count=len(hit))
            count[hit] = np.minimum(2, count[hit] + 1 + again)
        bits = [np.packbits(count[np.cumsum(unpacked(cells, np.uint32))] > 1).tobytes() for cells in hits]
        columns = [pa.array([block] * len(chunks), pa.int64()), pa.array(chunks, pa.int64()), pa.array(bits, pa.binary())]
        return pa.table(columns, ["block", "chunk", "bits"])

    return sketches.groupBy("block").applyInArrow(merge, ANSWERS)


ADDED = ["n_words", "n_removed", "kept"]
#: A candidate: the hash of its words, its document's key, its start, its document's row in the chunk.
ENTRY = {"h1": "<u8", "h2": "<u4", "k1": "<i8", "k2": "<i8", "pos": "<u4", "row": "<u4"}
Entries = dict[str, np.ndarray]


def _taken(entries: Entries, which: np.ndarray) -> Entries:
    return {n: a[which] for n, a in entries.items()}


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in columns])
    return new


def _later(entries: Entries) -> tuple[np.ndarray, Entries]:
    """Which entries are not the first of their window, being of another document or start; those entries."""
    order = np.argsort(entries["h1"])
    h1 = entries["h1"][order]
    new = _changes(h1)
    order = order[~(new & np.append(new[1:], True))]  # a hash that is alone says no more
    e = _taken(entries, order)
    within = np.lexsort([e[n] for n in ("pos", "k2", "k1", "h2", "h1")])
    e, order = _taken(e, within), order[within]
    new = _changes(e["h1"], e["h2"])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.logical_or.reduce([e[n][first] != e[n] for n in ("k1", "k2", "pos")]) if len(first) else new
    return order[later], _taken(e, later)


def _packed(entries: Entries) -> bytes:
    """Entries in order of document and start, as bytes: hashes as they are, the others as steps."""
    columns = []
    for name, a in entries.items():
        columns.append(a if name in ("h1", "h2") else np.diff(a, prepend=a[:1] * 0))
    return zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _unpacked(data: bytes, names: tuple[str, ...] = tuple(ENTRY)) -> Entries:
    raw, out, at = zstandard.decompress(data), {}, 0
    n = len(raw) // sum(np.dtype(ENTRY[name]).itemsize for name in names)
    for name in names:
        column = np.frombuffer(raw, ENTRY[name], n, at)
        out[name] = column if name in ("h1", "h2") else np.cumsum(column, dtype=ENTRY[name])
        at += column.nbytes
    return out


def _dealt(entries: Entries, part: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Entries packed by part, each in order of document and start."""
    order = np.lexsort([entries[n] for n in ("pos", "k2", "k1")])
    order = order[np.argsort(part[order], kind="stable")]
    cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            yield i, _packed({n: entries[n][order[a:b]] for n in ENTRY})


def _key() -> list:
    """k1, k2: what orders and names a document."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"),
        F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias("k2"),
    ]


FOUND = ("pos", "row")
DEALT = "bucket int, chunk long, decided boolean, packed binary"
DEALT_KINDS = [pa.int32(), pa.int64(), pa.bool_(), pa.binary()]


def _found(later: Entries) -> bytes:
    order = np.lexsort([later["pos"], later["row"]])
    return _packed({n: later[n][order] for n in FOUND})


def _candidates(chunks: DataFrame, answers: DataFrame, size: int, cells: int, buckets: int) -> DataFrame:
    """Rows of ``DEALT``: starts of a chunk already decided, or first occurrences there, by bucket of their hash."""
    names = [c.split()[0] for c in DEALT.split(", ")]

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        chunk = own.column("chunk")[0].as_py()
        row, at, low, high = _hashed(own.column("whole")[0].as_py(), size)
        bits = dict(zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True))
        hits = np.flatnonzero(Sketch(low, high, cells).repeated(bits))
        row = row[hits]
        key = [np.array(own.column(k)[0].as_py(), np.int64)[row] for k in ("k1", "k2")]
        entry = [low[hits], high[hits] >> np.uint64(32), *key, at[hits], row]
        entries = {n: a.astype(k) for (n, k), a in zip(ENTRY.items(), entry, strict=True)}
        which, later = _later(entries)
        rows = [(chunk % buckets, chunk, True, _found(later))] if len(which) else []
        stays = np.ones(len(hits), bool)
        stays[which] = False
        first = _taken(entries, stays)
        bucket = ((first["h1"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        rows += [(b, chunk, False, data) for b, data in _dealt(first, bucket, buckets)]
        return pa.Table.from_batches([_batch(names, DEALT_KINDS, rows)])

    own = chunks.select("chunk", "k1", "k2", "whole")
    answers = answers.withColumnRenamed("chunk", "of")
    return own.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, DEALT)


def _starts(candidates: DataFrame) -> DataFrame:
    """Starts of windows that also start earlier, by chunk."""

    def decide(table: pa.Table) -> pa.Table:
        chunks, decided, data = (table.column(c).to_pylist() for c in ("chunk", "decided", "packed"))
        rows = [(c, p) for c, d, p in zip(chunks, decided, data, strict=True) if d]
        firsts = [(c, _unpacked(p)) for c, d, p in zip(chunks, decided, data, strict=True) if not d]
        if firsts:
            entries = {n: np.concatenate([f[n] for _, f in firsts]) for n in ENTRY}
            source = np.repeat(np.arange(len(firsts)), [len(f["pos"]) for _, f in firsts])
            which, _ = _later(entries)
            which = np.sort(which)
            cuts = np.searchsorted(source[which], np.arange(len(firsts) + 1)).tolist()
            for (chunk, _), a, b in zip(firsts, cuts, cuts[1:], strict=False):
                if a < b:
                    rows.append((chunk, _found(_taken(entries, which[a:b]))))
        return pa.Table.from_batches([_batch(["of", "packed"], [pa.int64(), pa.binary()], rows)])

    return candidates.groupBy("bucket").applyInArrow(decide, "of long, packed binary")


def _chunks(docs: DataFrame, columns: list[str], chunk: int) -> DataFrame:
    """Rows of chunk, and of lists over its documents: k1, k2, whole (the text), and c0, c1, ... for ``columns``."""
    plain = [f"c{i}" for i in range(len(columns))]
    names = ["chunk", "k1", "k2", "whole", *plain]

    def flush(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        whole = pa.array([0, table.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, c.chunk(0)) for c in table.columns]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += pc.sum(pc.binary_length(batch.column(2))).as_py() or 0
            if n >= chunk:
                yield flush(number, held)
                held, n, number = [], 0, number + 1
        if held:
            yield flush(number, held)

    text = F.col("text").cast("binary").alias("whole")
    rows = docs.select(*_key(), text, *(F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain, strict=True)))
    kinds = ["bigint", "bigint", "binary", *(docs.schema[c].dataType.simpleString() for c in columns)]
    schema = ", ".join(f"{n} array<{k}>" for n, k in zip(names[1:], kinds, strict=True))
    return rows.mapInArrow(run, f"chunk long, {schema}")


def _as_text(values: pa.Array) -> pa.Array:
    return pc.cast(values, options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))


def _all_candidates(chunks: DataFrame, size: int, cells: int, buckets: int) -> DataFrame:
    return _candidates(chunks, _answers(_sketches(chunks, size, cells)), size, cells, buckets)


def _cells(windows: int) -> int:
    return max(1 << 16, 4 * windows)


def deduplicated(docs: DataFrame, size: int = WINDOW, cells: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the words left, joined by one space)."""
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = length // 6 + 1
    cells = cells or _cells(windows)
    columns = [c for c in docs.columns if c not in ADDED]
    # own names on the way, whatever the table's columns are called; the text is there once
    others = [c for c in columns if c != "text"]
    chunks = staged_by(_chunks(docs, others, chunk), "chunk", "texts")
    starts = _starts(_all_candidates(chunks, size, cells, windows // BLOCK_WINDOWS + 16))
    names = [*(f"c{i}" for i in range(len(others))), "whole", *ADDED]

    def cut(own: pa.Table, found: pa.Table) -> pa.Table:
        texts = own.column("whole").combine_chunks().flatten()
        gone_at = [_unpacked(p, FOUND) for p in found.column("packed").to_pylist()]
        rows = np.concatenate([np.empty(0, "<u4"), *(g["row"] for g in gone_at)])
        starts_at = np.concatenate([np.empty(0, "<u4"), *(g["pos"] for g in gone_at)])
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(len(texts) + 1)).tolist()
        counts, gone, kept = [], [], []
        for text, a, b in zip(texts.to_pylist(), cuts, cuts[1:], strict=False):
            words = text.split() if text else []
            counts.append(len(words))
            if a < b:
                at = starts_at[order[a:b]].astype(np.int64)  # all different
                edges = np.zeros(len(words) + 1, np.int64)
                edges[at] += 1
                edges[at + size] -= 1
                words = list(compress(words, (np.cumsum(edges)[:-1] == 0).tolist()))
            gone.append(counts[-1] - len(words))
            kept.append(b" ".join(words))
        lists = [own.column(n).combine_chunks().flatten() for n in names[: len(others)]]
        strings = [_as_text(texts), _as_text(pa.array(kept, pa.binary()))]
        return pa.table([*lists, strings[0], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), strings[1]], names)

    kinds = [docs.schema[c].dataType.simpleString() for c in others]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, [*kinds, "string", "long", "long", "string"], strict=True))
    out = chunks.drop("k1", "k2").groupBy("chunk").cogroup(starts.groupBy("of")).applyInArrow(cut, schema)
    return out.toDF(*others, "text", *ADDED).select(*(F.col(f"`{c}`") for c in [*columns, *ADDED]))


def removed(docs: DataFrame, size: int = WINDOW, cells: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_removed, kept."""
    return deduplicated(docs.select("doc_id", "text"), size, cells, chunk).drop("text")
