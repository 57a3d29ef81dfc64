"""Alignment of the tokens of two tokenizers, and how often each pair of ids is linked in the corpus.

Arrow all through.  A batch of texts is cut into units, each different unit is tokenized once, and lists of ids are taken
by unit: list flatten gives the tokens, parent indices their texts, cumulative sums of the tokens' bytes less those
at the text's start their ends.  An Acero hash join of both tables on (document, end) gives the links.  ``Table.group_by``
counts a chunk's pairs of ids, Spark adds up the counts of all chunks, and the corpus' counts come back to each
chunk by an equality join, to be added up over the links of each document.

Units: a text with a space before it is cut before every space that follows no space and that no white space follows.  Neither
tokenizer has a token across such a place: A begins a new match of its pattern there, and no piece of B has a space
after another character (``Pair`` makes sure).

The counts that a chunk gets back are those of its distinct pairs, of which it has at most one per link, about ``CHUNK``.
A pair that every chunk has comes once per chunk to the sum, which is combined before the shuffle.  The highest count of a B id is found among
at most as many pairs as A has ids.

Defined cases: a null or empty text, or one whose joined token bytes of A or B differ from the text with a space before it, has
no tokens and zeros; null ids stay null; repeated rows are texts of their own, and count; bytes that are no UTF-8 are replaced by
U+FFFD before anything else; a very long text stays whole in one batch; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CHUNK = 4_000_000
#: Distinct units a worker remembers the ids of.
KEPT = 400_000
CUT = re.compile(r"(?<! ) (?=\S)")


def _byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 characters as they are and the other bytes from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pair:
    """Both tokenizers, the bytes of their tokens, and the ids of the units seen."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        character = _byte_characters()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes = [[bytes(character.get(c, 0) for c in e) for e in entries], [_piece_bytes(p) for p in pieces]]
        self.sizes = [np.array([len(t) for t in own], np.int64) for own in self.bytes]
        self.cuts = CUT if not any(re.search("[^▁]▁", p) for p in pieces) else re.compile(r"(?!)")
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def units(self, text: str) -> list[str]:
        """The text's units, each without the space that it begins with."""
        first, *rest = self.cuts.split(" " + text)
        return [first[1:], *rest] if first else rest

    def learn(self, units: list[str]) -> None:
        """Ids of new units, as bytes, and whether the tokens' bytes are the unit's."""
        if len(self.known) > KEPT:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        for at in range(0, len(new), 5000):
            some = new[at : at + 5000]
            of_a = self.a.encode_batch_fast([" " + u for u in some], add_special_tokens=False)
            for unit, a, b in zip(some, of_a, self.b.encode(some, num_threads=1), strict=True):
                whole = b" " + unit.encode()
                same = all(b"".join(map(t.__getitem__, ids)) == whole for t, ids in zip(self.bytes, (a.ids, b), strict=True))
                self.known[unit] = np.array(a.ids, np.int32).tobytes(), np.array(b, np.int32).tobytes(), same


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _lists(parts: list[bytes]) -> pa.ListArray:
    """Integers as bytes to lists of them."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _tokens(units: pa.ListArray, ids: pa.ListArray, sizes: np.ndarray) -> pa.Table:
    """doc, end, place, id of all tokens of texts given as lists of places in ``ids``."""
    per_unit = ids.take(units.flatten())
    flat = pc.list_flatten(per_unit)
    doc = pc.list_parent_indices(units).take(pc.list_parent_indices(per_unit))
    size = pa.array(sizes).take(flat)
    to = pc.cumulative_sum(size)
    # the sum at the start of each text, for its tokens
    first = np.searchsorted(doc.to_numpy(), np.arange(len(units)))
    before = np.concatenate([[0], to.to_numpy()])[first]
    end = pc.subtract(to, pa.array(before).take(doc))
    return pa.table({"doc": doc, "end": end, "place": pa.array(np.arange(len(flat))), "id": flat})


def _grouped(ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """Ids of each group, joined by commas; ``ends`` are the places after the groups' last tokens."""
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, ids.cast(pa.string())), ",")


def align(texts: list[str | None], pair: Pair) -> tuple[pa.Table, pa.Table]:
    """n_a, n_b, n_groups, n_links, groups of each text; the links (doc, a, b) in order."""
    units = [pair.units(t) if t else [] for t in texts]
    places: dict[str, int] = {}
    codes = [[places.setdefault(u, len(places)) for u in own] for own in units]
    pair.learn(list(places))
    a_ids, b_ids, same = zip(*map(pair.known.__getitem__, places), strict=True) if places else ((), (), ())
    if not all(same):
        codes = [own if all(same[c] for c in own) else [] for own in codes]
    in_units = pa.array(codes, pa.list_(pa.int32()))
    a, b = (_tokens(in_units, _lists(ids), sizes) for ids, sizes in zip((a_ids, b_ids), pair.sizes, strict=True))
    links = a.join(b, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by("place")
    at_a, at_b = links.column("place").to_numpy(), links.column("place_b").to_numpy()
    of_group = links.column("doc").to_numpy()
    texts_of = pc.binary_join_element_wise(
        _grouped(a.column("id").combine_chunks(), at_a + 1), _grouped(b.column("id").combine_chunks(), at_b + 1), "|"
    )
    n = np.arange(len(texts) + 1)
    offsets = pa.array(np.searchsorted(of_group, n), pa.int32())
    groups = pc.binary_join(pa.ListArray.from_arrays(offsets, texts_of), ";")
    counts = [np.diff(np.searchsorted(t.column("doc").to_numpy(), n)) for t in (a, b, links, links)]
    docs = pa.table([*map(pa.array, counts), groups], ["n_a", "n_b", "n_groups", "n_links", "groups"])
    return docs, pa.table({"doc": of_group, "a": links.column("id"), "b": links.column("id_b")})


#: A document's row, with the places of its links in the chunk's list of pairs; or (kind 1) a pair and its count in the chunk.
ROWS = (
    "kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, "
    "a int, b int, n long"
)
KINDS = [pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _filled(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of ``ROWS``, null where no column is given."""
    arrays = [columns[c].cast(k) if c in columns else pa.nulls(n, k) for c, k in zip(NAMES, KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def _chunks(docs: DataFrame, a_path: str, b_path: str, digest: bool, chunk: int) -> DataFrame:
    """Rows of ``ROWS``."""

    def flush(number: int, held: list[tuple[pa.Table, pa.Table]]) -> Iterator[pa.RecordBatch]:
        rows, links = pa.concat_tables([d for d, _ in held]), pa.concat_tables([k for _, k in held])
        counted = links.select(["a", "b"]).group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
        counted = counted.sort_by([("a", "ascending"), ("b", "ascending")])
        both = [t.column("a").to_numpy().astype(np.int64) << 32 | t.column("b").to_numpy() for t in (counted, links)]
        codes = np.searchsorted(*both).astype(np.int32)
        cuts = np.cumsum(rows.column("n_links").to_numpy())[:-1]
        packed = pa.array([zstandard.compress(c.tobytes(), 1) if len(c) else None for c in np.split(codes, cuts)], pa.binary())
        own = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        for table in ({"kind": np.zeros(rows.num_rows, np.int32), **own, "links": packed},
                      {"kind": np.ones(counted.num_rows, np.int32), "a": counted.column("a").combine_chunks(),
                       "b": counted.column("b").combine_chunks(), "n": counted.column("count_all").combine_chunks()}):
            n = len(table["kind"])
            batch = _filled(n, {**table, "kind": pa.array(table["kind"]), "chunk": pa.array(np.full(n, number))})
            for at in range(0, n, 10_000):
                yield batch.slice(at, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, n, number = _pair(a_path, b_path), [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, links = align(batch.column(1).to_pylist(), pair)
            if digest:
                hashed = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in rows.column("groups").to_pylist()]
                rows = rows.set_column(4, "groups", pa.array(hashed, pa.string()))
            held.append((rows.add_column(0, "doc_id", batch.column(0)), links))
            n += links.num_rows
            if n >= chunk:
                yield from flush(number, held)
                held, n, number = [], 0, number + 1
        if held:
            yield from flush(number, held)

    rows = docs.select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, ROWS)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b, count, best: how many links of the corpus hold the pair, and whether that is the highest count of its b."""
    counts = chunks.filter("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _summed(own: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with their links' counts."""
    counts = counts.sort_by([("a", "ascending"), ("b", "ascending")])
    count, best = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    sums, bests = [], []
    for data in own.column("links").to_pylist():
        links = np.frombuffer(zstandard.decompress(data), np.int32) if data else np.empty(0, np.int32)
        sums.append(int(count[links].sum()))
        bests.append(int(best[links].sum()))
    new = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    return pa.table([new[c] if c in new else own.column(c) for c in names], names)


def aligned(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``ALIGNED`` of every row of ``docs`` (doc_id, text); ``digest``: the SHA-256 of groups, '' if none, in their place."""
    chunks = staged(_chunks(docs, a_path, b_path, digest, chunk), "chunks")
    counts = pair_counts(chunks)
    back = chunks.filter("kind = 1").select(F.col("chunk").alias("of"), "a", "b").join(counts, ["a", "b"])
    rows = chunks.filter("kind = 0").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links")
    return rows.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_summed, ALIGNED)
