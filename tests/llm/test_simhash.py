import random
from itertools import combinations

import numpy as np
import xxhash

from stayline.llm import simhash
from stayline.llm.common import small_batches

SCHEMA = "doc_id long, text string, lang string, fp string, bucket long"


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 3:
                root[top(a)] = top(b)
    return {f: top(f) for f in fps}


def test_links_against_brute_force_at_any_bucket_limit(spark):
    small_batches(spark)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    weak = rng.sample(range(64), 9)
    fps = {centre ^ sum(1 << b for b in weak if rng.random() < 0.4) for _ in range(300)}
    fps |= {rng.getrandbits(64) for _ in range(50)} | {0, 1, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    wanted = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bucket in (256, 12, 2):
        assert {tuple(r) for r in simhash.links(df, bucket).collect()} == wanted


def test_links_under_one_hot_key_against_every_wiped_bit(spark):
    """100,000 fingerprints share their upper half; every one is looked up with every choice of up to three bits changed."""
    small_batches(spark)
    low = np.unique(np.random.default_rng(9).integers(0, 1 << 32, 100_000, np.uint32))
    low = np.unique(np.append(low, low[:500] ^ np.uint32(1 << 7)))
    high = 0x1234ABCD << 32
    wanted = set()
    for n in (1, 2, 3):
        for bits in combinations(range(32), n):
            other = low ^ np.uint32(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(low, other), len(low) - 1)
            met = (low[at] == other) & (low > other)
            wanted |= set(zip(low[met].tolist(), other[met].tolist(), strict=True))
    df = spark.createDataFrame([(high | int(v),) for v in low], "fp long")
    found = [(r.u - high, r.v - high) for r in simhash.links(df).collect()]
    assert len(wanted) > 5000 and len(found) == len(wanted) and set(found) == wanted


def test_components_of_edge_rows(spark):
    small_batches(spark)
    base = " ".join(f"word{i}" for i in range(400))
    texts = [base, base.upper(), base + " end", "", None, " \n\t", "two words", "One", base.replace("word7 ", "x "), base]
    rows = [(i if i != 9 else None, t, "en", "clash", 1) for i, t in enumerate(texts)] + [(0, base, None, "", None)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = {i: plain_fingerprint(t) for i, t, *_ in rows}
    tops = plain_components(set(fps.values()))
    first = {}
    for i, f in fps.items():
        first[tops[f]] = min(first.get(tops[f], 99), 99 if i is None else i)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == sorted(
        (str(i), f"{fps[i]:016x}", first[tops[fps[i]]]) for i, *_ in rows
    )
    kept = simhash.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "fp", "bucket"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        [str(i) for i in set(first.values())] + ["None"]
    )
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_component_where_ids_repeat(spark):
    small_batches(spark)
    a, b = (" ".join(f"{w}{i}" for i in range(80)) for w in ("one", "two"))
    rows = [(1, a), (7, a), (7, b)]
    for given in (rows, rows[::-1], [*rows, (7, b), (1, a), (9, b + " ")]):
        docs = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, simhash.keep_first(docs).collect())) == [(1, a), (7, b)]
    # one id for two roots, and for two texts of one root: one row of each root
    spaced = [(7, a), (7, a + " "), (7, b), (None, a), (3, None), (3, "")]
    kept = simhash.keep_first(spark.createDataFrame(spaced, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), (r.text or "").strip()) for r in kept) == [("3", ""), ("7", a), ("7", b), ("None", a)]


def test_query_against_brute_force(spark, folder):
    from stayline.llm.queries import op2_simhash

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    fps = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    tops = plain_components(set(fps.values()))
    first = {}
    for i, f in fps.items():
        first[tops[f]] = min(first.get(tops[f], i), i)
    found = op2_simhash(spark, folder).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {
        (i, f"{f:016x}", first[tops[f]]) for i, f in fps.items()
    }
    assert len(found) == len(docs)


def test_lower_cases_ascii_only(spark):
    assert simhash.fingerprint("É A".encode()) == simhash.fingerprint("É a".encode())
    assert simhash.fingerprint("É a".encode()) != simhash.fingerprint("é a".encode())
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)
