"""Byte-level BPE by a tree: halves are encoded, and neighbours are joined at their seam.

Two trees, one inside the other.  A text is a tree of spans: spans of letters, numbers, marks and spaces
(the pattern's matches) are found in short leaves, and where two leaves meet the pattern is matched again
from the last match that cannot have looked past the seam until a match ends where one of the right leaf
ends; as a match depends on the text from its start only, all later ones stand.  A match is a tree of
bytes: encode both halves, then re-encode a window of tokens around the seam, growing it until its outer
pairs of tokens stay apart when encoded by themselves.  No merge can cross such a pair, so the tokens
outside are final.  Decoding joins the bytes of halves up the tree.

Defined cases: a null text is an empty one, which has no ids; repeated rows keep all their rows; other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters in a leaf of a text, bytes in a leaf of a match.
LEAF_CHARS = 4096
LEAF_BYTES = 24
#: Windows longer than this are merged with a heap.
HEAP_BYTES = 256
#: A match that ends so many characters before the end of a leaf has not looked past it.
AHEAD = 4
#: Matches whose ids a worker remembers; longer ones than ``KEPT_CHARS`` are not kept.
KEPT = 400_000
KEPT_CHARS = 64


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec per worker and vocabulary."""
    return ByteBpe(path, pattern)


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.ids: dict[str, list[int]] = {}

    # --- one match -----------------------------------------------------------------------------

    def _merge(self, data: bytes) -> list[bytes]:
        """Merge the pair of the lowest rank, the leftmost of equals, until no pair is a token."""
        if len(data) > HEAP_BYTES:
            return self._merge_by_heap(data)
        rank, never = self.rank.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], never) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) != never:
            at = pairs.index(low)
            both = parts[at] + parts[at + 1]
            parts[at : at + 2] = [both]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + both, never)
            if at < len(pairs):
                pairs[at] = rank(both + parts[at + 1], never)
        return parts

    def _merge_by_heap(self, data: bytes) -> list[bytes]:
        """The same for long data: pairs wait in a heap, those whose parts have changed are passed over."""
        rank, n = self.rank.get, len(data)
        ends = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
        before = list(range(-1, n))

        def pair(a: int) -> tuple[int, int, int, int] | None:
            b = ends[a]
            found = rank(data[a : ends[b]]) if b < n else None
            return None if found is None else (found, a, b, ends[b])

        waiting = [p for p in map(pair, range(n - 1)) if p]
        heapq.heapify(waiting)
        while waiting:
            _, a, b, end = heapq.heappop(waiting)
            if ends[a] != b or ends[b] != end:
                continue
            ends[a], ends[b], before[end] = end, 0, a
            for start in (before[a], a):
                if start >= 0 and (p := pair(start)):
                    heapq.heappush(waiting, p)
        parts, a = [], 0
        while a < n:
            parts.append(data[a : ends[a]])
            a = ends[a]
        return parts

    def _encode(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF_BYTES:
            return self._merge(data)
        half = len(data) // 2
        return self._join(self._encode(data[:half]), self._encode(data[half:]))

    def _apart(self, a: bytes, b: bytes) -> bool:
        """No merge crosses from a to b: encoded together they come out as they are."""
        return self._merge(a + b) == [a, b]

    def _join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if self._apart(left[-1], right[0]):
            left.extend(right)
            return left
        a, b = 1, 1
        while True:
            data = b"".join(left[-a:] + right[:b])
            window = self._merge(data)
            more_left = a < len(left) and not self._apart(left[-a - 1], window[0])
            more_right = b < len(right) and not self._apart(window[-1], right[b])
            if not more_left and not more_right:
                break
            a, b = min(len(left), a * 2) if more_left else a, min(len(right), b * 2) if more_right else b
        del left[len(left) - a :]
        left.extend(window)
        left.extend(right[b:])
        return left

    def match(self, text: str) -> list[int]:
        """The ids of one match of the pattern."""
        data = text.encode()
        whole = self.rank.get(data)
        found = [whole] if whole is not None else [self.rank[part] for part in self._encode(data)]
        if len(text) <= KEPT_CHARS:
            if len(self.ids) >= KEPT:
                self.ids.clear()
            self.ids[text] = found
        return found

    # --- one text ------------------------------------------------------------------------------

    def _leaf(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _meet(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of two neighbouring spans of a text, from those of each."""
        tail, n = [], 0
        while left and n < AHEAD:
            n += len(left[-1])
            tail.append(left.pop())
        if left and left[-1].isspace():  # spaces before the tail may have been cut for it
            tail.append(left.pop())
        tail = "".join(reversed(tail))
        take = 4
        while True:
            head = "".join(right[:take])
            found, at = [], 0
            ends, end = set(), len(tail)
            for piece in right[:take]:
                end += len(piece)
                ends.add(end)
            last = take >= len(right)
            for m in self.pattern.finditer(tail + head):
                if not last and m.end() > len(tail) + len(head) - AHEAD:
                    break
                found.append(m.group())
                at = m.end()
                if at in ends:
                    break
            if at in ends or last:
                break
            take *= 2
        used, end = 0, len(tail)
        while used < len(right) and end < at:
            end += len(right[used])
            used += 1
        left.extend(found)
        left.extend(right[used:])
        return left

    def matches(self, text: str) -> list[str]:
        """All matches of the pattern in a text, leaves first, then pairs of neighbours."""
        level = [self._leaf(text[i : i + LEAF_CHARS]) for i in range(0, len(text), LEAF_CHARS)]
        while len(level) > 1:
            joined = [self._meet(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = joined + level[len(level) & ~1 :]
        return level[0] if level else []

    def encode(self, text: str) -> array:
        ids, known = array("I"), self.ids.get
        for piece in self.matches(text):
            ids.extend(known(piece) or self.match(piece))
        return ids

    def decode(self, ids: array) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = [own.encode(text or "") for text in batch.column(1).to_pylist()]
            lists = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary) of rows doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = [own.decode(array("I", ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids, and digests both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, before, after = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                counts.append(len(ids))
                before.append(hashlib.sha256(ids.tobytes()).hexdigest())
                after.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
