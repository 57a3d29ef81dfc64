import random
import zlib

import numpy as np
import pytest

from stayline.llm import packing
from stayline.llm.common import small_batches, staged
from stayline.llm.queries import END_ID, WORD_VOCABULARY
from stayline.llm.wordpiece import WhiteSpaceEncoder


def one_by_one(lengths, capacity):
    """Best-two-fit, a bin at a time, on plain lists."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        gap, filled = capacity, []
        while fits := next((n for n in left if n <= gap), 0):
            left.remove(fits)
            filled.append(fits)
            gap -= fits
        if gap and len(filled) > 1:
            pairs = [(a + b, a) for i, a in enumerate(left) for b in left[i + 1 :] if filled[-1] < a + b <= gap + filled[-1]]
            pairs += [(s, s - a) for s, a in pairs]  # either way round
            if pairs:
                total, a = max(pairs, key=lambda p: (p[0], -p[1]))
                left.append(filled.pop())
                left.remove(a)
                left.remove(total - a)
                left.sort(reverse=True)
                filled += [a, total - a]
        bins.append(sorted(filled))
    return sorted(bins)


@pytest.mark.parametrize("capacity", [7, 30, 100])
def test_plan_equals_filling_one_by_one(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        lengths += [rng.randint(1, capacity)] * rng.choice([0, 25])
        counts = {n: lengths.count(n) for n in lengths}
        bins = [sorted(n for n, k in each.items() for _ in range(k)) for times, each in packing.plan(counts, capacity) for _ in range(times)]
        assert sorted(bins) == one_by_one(lengths, capacity)


def test_pieces_and_places_of_edge_rows(spark):
    small_batches(spark)
    own = WhiteSpaceEncoder(WORD_VOCABULARY)
    rows = [(i, "word " * (i % 23), "x") for i in range(200)] + [(None, None, ""), (7, "", ""), (3, "same", ""), (3, "same", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    found = packing.pack(staged(packing.pieces(docs, WORD_VOCABULARY, END_ID, 10, ids=True), "pieces"), 10)
    wanted = []
    for doc_id, text, _ in rows:
        ids = [*own.whole(text or ""), END_ID]
        for piece, at in enumerate(range(0, len(ids), 10)):
            part = ids[at : at + 10]
            wanted.append((str(doc_id), piece, at, len(part), zlib.crc32(np.array(part, "<u4")), part))
    got = found.collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == sorted(wanted)
    whole = {r.sequence_id: r.ids for r in packing.sequences(found).collect()}
    for r in got:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert max(map(len, whole.values())) <= 10 and sum(map(len, whole.values())) == sum(w[3] for w in wanted)
    assert len(whole) <= sum(map(len, whole.values())) / 10 + 2
    assert packing.pack(staged(packing.pieces(docs.limit(0), WORD_VOCABULARY, END_ID, 10), "none"), 10).count() == 0
