"""Language-model scores of texts by a weighted backoff automaton.

The model: n-grams up to trigrams of all training texts, smoothed towards the next shorter history h',
``p(w|h) = (c(hw) + PRIOR * p(w|h')) / (c(h) + PRIOR)``, down to ``p(w) = (c(w) + 1) / (N + V + 1)``, so that for every history
the probabilities of all known words, the end and one unknown word add up to one.  As an automaton: every history seen is a
state; an arc of a state is an n-gram seen there, with its smoothed probability, and leads to the longest history
it makes; the failure arc leads to the state of the history less its first word, with the weight ``PRIOR / (c(h) + PRIOR)``.  A text is read
once from left to right: the state is carried on, log-probabilities are added up.

The corpus' model is larger than any machine's memory, so no task holds it.  Texts are read in chunks of about
``CHUNK`` tokens, kept in a table bucketed by chunk.  Order by order, a chunk sends the sorted hashes of its n-grams, with
their training counts, to buckets that cover ranges of hashes; a bucket (about ``BUCKET`` n-grams, as many buckets as the text
needs) adds the counts of all chunks and answers each with the corpus' counts in the order of its n-grams.  From these a
chunk builds exactly the part of the automaton that its texts can reach.  If no other chunk has an n-gram's history, or
the n-gram less its first word, be it only in texts to be scored, then none has the n-gram either, and the chunk's own count is
the answer: most long n-grams are never sent.  An n-gram comes once per chunk however often the text has it, so a hot word costs a bucket 9
bytes per chunk.  Nothing is left out: all n-grams of all training texts count.

Defined cases: a null or empty text is the end alone; a null id is drawn like an empty one, and returned null;
repeated rows are texts of their own; bytes that are no UTF-8 are parts of words like all others; a very long
text stays whole, in a chunk of its own size; other columns are ignored; an empty table gives an empty one.  N-grams are told apart by 64-bit hashes:
for 10^8 different words the chance that any two share one is 3 in 10,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, staged, staged_by, unpacked

ORDER = 3
#: Pseudo-counts of the shorter history, by the length of the longer one.
PRIORS = {1: 1000.0, 2: 4.0}
CHUNK = 500_000
BUCKET = 2_000_000
#: Distinct words a worker remembers the hashes of.
KEPT = 500_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Hashes of the two marks, of strings that are no words.
BEGIN, END = xxhash.xxh3_64_intdigest(b" "), xxhash.xxh3_64_intdigest(b"")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        """BEGIN, the text's words, END."""
        words = text.translate(LOWER).split() if text else []
        out = np.empty(len(words) + 2, np.uint64)
        out[0], out[-1] = BEGIN, END
        out[1:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Grams:
    """The distinct n-grams of a run of texts, in order of their hashes, and which of them ends at each token.

    ``keys[k]`` are those of k + 1 words, ``at[k]`` has the place there of the one that ends at a token, -1 where the text began
    later.  ``last``, ``history`` and ``shorter`` have an n-gram's last word, itself without it, and itself without its first
    word.  The begin mark is a history, never predicted.
    """

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, order: int = ORDER):
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(hashes)) - np.repeat(starts, lengths)
        self.keys, self.at, run = [], [], hashes
        self.last, self.history, self.shorter = ([np.empty(0, np.int64)] for _ in range(3))
        for k in range(order):
            if k:
                run = np.concatenate([np.zeros(1, np.uint64), _joined(run[:-1], hashes[1:])])
            whole = np.flatnonzero(place >= k)
            keys, first, inverse = np.unique(run[whole], return_index=True, return_inverse=True)
            at = np.full(len(hashes), -1, np.int64)
            at[whole] = inverse
            self.keys.append(keys)
            self.at.append(at)
            if k:
                example = whole[first]
                self.last.append(self.at[0][example])
                self.history.append(self.at[k - 1][example - 1])
                self.shorter.append(self.at[k - 1][example])

    def own_counts(self, k: int, chosen: np.ndarray) -> np.ndarray:
        """How often each n-gram of k + 1 words ends at a chosen token."""
        return np.bincount(self.at[k][chosen & (self.at[k] >= 0)], minlength=len(self.keys[k]))


class Automaton:
    """The states and arcs that the texts of ``grams`` can reach; ``counts`` are the corpus' counts of its n-grams.

    An arc is an n-gram the corpus has: it leaves the state of its history with its last word.  So the arc by which a token leaves
    the state of the k words before it is the n-gram of k + 1 words that ends there, if that has a weight.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], n: int, v: int):
        self.grams, self.known = grams, counts[0] > 0
        share = (counts[0] + 1) / (n + v + 1)
        self.weight, self.failure = [np.log10(share)], [np.zeros(1)]
        for k in range(1, len(counts)):
            share = (counts[k] + PRIORS[k] * share[grams.shorter[k]]) / (counts[k - 1][grams.history[k]] + PRIORS[k])
            self.weight.append(np.where(counts[k] > 0, np.log10(share), np.nan))
            self.failure.append(np.log10(PRIORS[k] / (counts[k - 1] + PRIORS[k])))

    def scores(self, starts: list[int], ends: list[int]) -> list[float]:
        """log10 probabilities of the texts at these tokens, each less its first, the begin mark."""
        at, tokens = self.grams.at, len(self.grams.at[0])
        arcs, failures = [self.weight[0][at[0]]], []
        for k in range(1, len(self.weight)):
            arcs.append(np.where(at[k] >= 0, self.weight[k][at[k]], np.nan) if len(self.weight[k]) else np.full(tokens, np.nan))
            failures.append(np.concatenate([[0.0], self.failure[k][at[k - 1][:-1]]]))
        columns = [c.tolist() for c in (*arcs, *failures, self.known[at[0]])]
        return [self._walked(*(c[a + 1 : b] for c in columns)) for a, b in zip(starts, ends, strict=True)]

    @staticmethod
    def _walked(none: list, one: list, two: list, fail_one: list, fail_two: list, known: list) -> float:
        """Once from left to right: ``state`` is how many words back the automaton's state reaches."""
        state, total = 1, 0.0
        for arc_none, arc_one, arc_two, failure_one, failure_two, seen in zip(none, one, two, fail_one, fail_two, known, strict=True):
            if state == 2:
                if arc_two == arc_two:  # there is such an arc
                    total += arc_two
                    continue
                total += failure_two
                state = 1
            if state == 1:
                if arc_one == arc_one:
                    total += arc_one
                    state = 2
                    continue
                total += failure_one
            total += arc_none
            state = 1 if seen else 0
        return total


def _ascending(hashes: np.ndarray) -> bytes:
    return packed(np.diff(hashes, prepend=np.uint64(0)))


def _hashes(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


CHUNKS = "chunk long, words binary, text binary, doc_ids array<long>, held array<boolean>, lengths array<long>"
CHUNK_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]


def _batch(schema: str, kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _chunks(docs: DataFrame, held: Column, chunk: int) -> DataFrame:
    """Rows of ``CHUNKS``: the hashes of the chunk's words, its texts as places among them, the texts' rows."""

    def flush(number: int, ids: list, outs: list, hashes: list) -> pa.RecordBatch:
        words, text = np.unique(np.concatenate(hashes), return_inverse=True)
        row = (number, _ascending(words), packed(text.astype(np.uint32)), ids, outs, [len(h) for h in hashes])
        return _batch(CHUNKS, CHUNK_KINDS, [row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, number = WordHashes(), 0, TaskContext.get().partitionId() << 32
        ids, outs, hashes = [], [], []
        for batch in batches:
            for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                outs.append(out)
                hashes.append(known.of(text))
                n += len(hashes[-1])
                if n >= chunk:
                    yield flush(number, ids, outs, hashes)
                    ids, outs, hashes, n, number = [], [], [], 0, number + 1
        if ids:
            yield flush(number, ids, outs, hashes)

    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk's texts, and the corpus' counts of its n-grams as far as they are answered."""

    def __init__(self, row: dict, answers: list[dict], order: int):
        self.lengths = np.array(row["lengths"])
        self.grams = Grams(_hashes(row["words"])[unpacked(row["text"], np.uint32)], self.lengths, order)
        self.chosen = np.repeat(~np.array(row["held"]), self.lengths)
        answered: dict[int, list] = {}
        for a in sorted(answers, key=lambda a: (a["order"], a["bucket"])):
            answered.setdefault(a["order"], []).append(unpacked(a["counts"], np.int64))
        self.counts: list[np.ndarray] = []
        self.elsewhere: list[np.ndarray] = []
        for k in range(order if answers else 0):
            asked = self.asked(k)
            if k + 1 in answered or not asked.any():
                self.counts.append(self.grams.own_counts(k, self.chosen))
                self.elsewhere.append(np.zeros(len(asked), bool))
                if k + 1 in answered:
                    found = np.concatenate(answered[k + 1])
                    self.counts[k][asked], self.elsewhere[k][asked] = found >> 1, found & 1 == 1

    def asked(self, k: int) -> np.ndarray:
        """Which n-grams of k + 1 words other chunks may have, by what is known of the shorter ones."""
        if not k:
            return np.ones(len(self.grams.keys[0]), bool)
        return self.elsewhere[k - 1][self.grams.history[k]] & self.elsewhere[k - 1][self.grams.shorter[k]]

    def parts(self, number: int, edges: np.ndarray) -> Iterator[tuple]:
        """Rows of ``PARTS`` for the order that follows the answers."""
        k = len(self.grams.keys) - 1
        asked = self.asked(k)
        keys, counts = self.grams.keys[k][asked], self.grams.own_counts(k, self.chosen)[asked]
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i < j:
                yield b, number, _ascending(keys[i:j]), packed(counts[i:j].astype(np.uint32))


#: A chunk's n-grams of one bucket.
PARTS = "bucket int, chunk long, hashes binary, counts binary"
PART_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
ANSWERS = "order int, bucket int, chunk long, counts binary, known long"


def _with_answers(chunks: DataFrame, answers: DataFrame | None, function, schema: str) -> DataFrame:
    """``function`` of each chunk's row and the answers to it, on the task that has the row."""

    def alone(table: pa.Table) -> pa.Table:
        return function(table.to_pylist()[0], [])

    def both(table: pa.Table, found: pa.Table) -> pa.Table:
        return function(table.to_pylist()[0], found.to_pylist())

    if answers is None:
        return chunks.groupBy("chunk").applyInArrow(alone, schema)
    own = answers.filter("chunk IS NOT NULL").select(F.col("chunk").alias("of"), "order", "bucket", "counts")
    return chunks.groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(both, schema)


def _parts(chunks: DataFrame, answers: DataFrame | None, order: int, buckets: int) -> DataFrame:
    """Rows of ``PARTS`` for n-grams of ``order`` words, of which the shorter ones are answered."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def ask(row: dict, found: list[dict]) -> pa.Table:
        return pa.Table.from_batches([_batch(PARTS, PART_KINDS, list(Chunk(row, found, order).parts(row["chunk"], edges)))])

    needed = chunks.select("chunk", "words", "text", "held", "lengths")
    return _with_answers(needed, answers, ask, PARTS)


def _answers(parts: DataFrame, order: int) -> DataFrame:
    """Twice the corpus' counts of each chunk's n-grams by bucket, and one if another chunk has them too; without a chunk: how
    many words are known.
    """

    def add(table: pa.Table) -> pa.Table:
        hashes = [_hashes(d) for d in table.column("hashes").to_pylist()]
        counts = np.concatenate([unpacked(d, np.uint32) for d in table.column("counts").to_pylist()])
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, counts)
        known = int(((total > 0) & (distinct != np.uint64(BEGIN))).sum()) if order == 1 else 0
        told_all = total * 2 + (np.bincount(inverse) > 1)
        told = [packed(c) for c in np.split(told_all[inverse], np.cumsum([len(h) for h in hashes])[:-1])]
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        rows = [(order, bucket, c, p, None) for c, p in zip(chunks, told, strict=True)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
        return pa.Table.from_batches([_batch(ANSWERS, kinds, [*rows, (order, bucket, None, None, known)])])

    return parts.groupBy("bucket").applyInArrow(add, ANSWERS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, held: Column, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """``SCORES`` of every row of ``docs`` (doc_id, text), by a model of the rows for which ``held`` is false."""
    length, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    chunks = staged_by(_chunks(docs, held, chunk), "chunk", "chunks")
    buckets, answers = (length // 6 + 2 * rows) // bucket + 8, None
    for order in range(1, ORDER + 1):
        more = staged(_answers(_parts(chunks, answers, order, buckets), order), "answers")
        answers = answers.union(more) if answers else more
    each = F.arrays_zip("held", "lengths")
    trained = F.aggregate(each, F.lit(0).cast("long"), lambda n, x: n + F.when(x["held"], 0).otherwise(x["lengths"] - 1))
    n = chunks.agg(F.coalesce(F.sum(trained), F.lit(0))).first()[0]
    v = answers.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]

    def walk(row: dict, found: list[dict]) -> pa.Table:
        own = Chunk(row, found, ORDER)
        automaton, text = Automaton(own.grams, own.counts, n, v), own.grams.at[0]
        ends = np.cumsum(own.lengths)
        starts = ends - own.lengths
        token = np.ones(len(text), bool)
        token[starts] = False  # the begin marks
        columns = [
            row["doc_ids"],
            row["held"],
            own.lengths - 1,
            np.add.reduceat((automaton.known[text] & token).astype(np.int64), starts),
            np.full(len(starts), n),
            np.add.reduceat(np.where(token, np.log10((own.counts[0] + 1) / (n + v + 1))[text], 0), starts),
            automaton.scores(starts.tolist(), ends.tolist()),
        ]
        names = [c.split()[0] for c in SCORES.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return _with_answers(chunks, answers, walk, SCORES)
