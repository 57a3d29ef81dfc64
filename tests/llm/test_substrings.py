import hashlib
import random
import re

import numpy as np

from stayline.llm import substrings
from stayline.llm.common import small_batches, staged_by

SCHEMA = "doc_id long, text string, k1 string, kept int"


def plain(rows, size):
    """Rows (doc_id, text) in order of id, all different: (n_words, n_removed, kept) of each."""
    seen, out = set(), []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def test_rolled_hashes_tell_runs_apart():
    rng = random.Random(1)
    words = np.array([rng.getrandbits(64) for _ in range(60)], np.uint64)
    for size in (1, 2, 3, 5, 20):
        rolled = substrings._rolled(words, size)
        assert len(rolled) == len(words) - size + 1 == len(set(rolled.tolist()))
        assert rolled[7] == substrings._rolled(words[7 : 7 + size], size)[0]


def test_against_brute_force(spark, monkeypatch):
    small_batches(spark, 7)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["é", "a\x1cb", "\xa0"]
    pieces = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) for _ in range(12)]
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(80)]
    texts += [None, "", "x", " ".join(["again"] * 40), "tail " + " ".join(["again"] * 9)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)
    for cells in (1 << 16, 1 << 8):  # the second one is full: all windows are grouped exactly
        found = sorted(substrings.removed(df, 5, cells).collect())
        assert [tuple(r)[1:] for r in found] == plain(rows, 5)


def test_filter_stays_sharp_beyond_the_cells(spark):
    small_batches(spark, 2)
    rng, common = random.Random(8), " ".join(f"again{i}" for i in range(12))
    rows = [(i, " ".join(f"{rng.getrandbits(32):08x}" for _ in range(60)) + (f" {common}" if i % 3 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    windows = sum(len(t) for _, t in rows) // 6 + 1
    cells = 4 * windows
    chunks = staged_by(substrings._chunks(df, [], 2000), "chunk", "test")
    assert chunks.count() > 10
    found = substrings._all_candidates(chunks, 5, cells, 1).filter("NOT decided").collect()
    entries = [e for r in found for e in zip(*(substrings._unpacked(r.packed)[n].tolist() for n in ("k1", "pos")), strict=True)]
    assert len(set(entries)) == len(entries)
    alone = sum(not (i % 3 and at >= 60) for i, at in entries)  # let through without need
    assert alone < 0.1 * sum(60 if i % 3 else 56 for i, _ in rows)
    for size in (2000, 1 << 20):
        out = substrings.removed(df, 5, cells, size).select("n_words", "n_removed", "kept")
        assert sorted(map(tuple, out.collect())) == sorted(plain(rows, 5))


def test_several_blocks_and_parts_of_long_texts(spark, monkeypatch):
    """In this process, as the bounds are constants."""
    monkeypatch.setattr(substrings, "BLOCK", 1 << 6)
    monkeypatch.setattr(substrings, "AT_ONCE", 11)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)).encode() for n in (0, 3, 4, 5, 70, 200, 12)]
    row, at, low, high = substrings._hashed(texts, 4)
    words = [t.split() for t in texts]
    windows = [tuple(words[r][a : a + 4]) for r, a in zip(row.tolist(), at.tolist(), strict=True)]
    assert sorted(zip(row.tolist(), at.tolist(), strict=True)) == [(r, a) for r, w in enumerate(words) for a in range(len(w) - 3)]
    sketch = substrings.Sketch(low, high, 1 << 10)
    blocks = list(sketch.blocks())
    assert len(blocks) > 20 and len({b for b, _, _ in blocks}) == len(blocks)
    repeated = sketch.repeated({b: np.packbits(more).tobytes() for b, _, more in blocks}).tolist()
    assert all(flag for w, flag in zip(windows, repeated, strict=True) if windows.count(w) > 1)
    assert not all(repeated)


def test_bytes_that_are_no_text(spark):
    small_batches(spark)
    rows = spark.createDataFrame([(1, "61FF2062"), (2, "61FF2062206363"), (3, "7820")], "doc_id long, x string")
    docs = rows.selectExpr("doc_id", "cast(unhex(x) as string) as text", "x")
    out = substrings.deduplicated(docs, 2).selectExpr("doc_id", "n_words", "n_removed", "hex(cast(kept as binary))").collect()
    assert sorted(map(tuple, out)) == [(1, 2, 0, "61FF2062"), (2, 3, 2, "6363"), (3, 1, 0, "78")]


def test_edge_rows(spark):
    small_batches(spark)
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(None, text, "", 1), (4, text, "", 1), (4, text, "", 1), (7, "only one", "", 2)]
    out = substrings.deduplicated(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "k1", "n_words", "n_removed", "kept"]
    found = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in out.collect())
    assert found == [("4", 30, 30), ("4", 30, 30), ("7", 2, 0), ("None", 30, 0)]
    assert substrings.removed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_brute_force(spark, folder):
    from stayline.llm.queries import op3_substrings

    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    wanted = [(n, gone, hashlib.sha256(kept.encode()).hexdigest()) for n, gone, kept in plain(docs, 20)]
    assert [tuple(r)[1:] for r in sorted(op3_substrings(spark, folder).collect())] == wanted
