from collections import Counter

import pytest

from stayline.llm import sharding


def plain(rows, hashes, shards):
    """(row, shard, slot) by sorting on the driver."""
    by = {}
    for row, h in zip(rows, hashes, strict=True):
        by.setdefault((row[1] is None, row[1] or ""), []).append((h, row))
    placed = []
    for key, members in by.items():
        members.sort(key=lambda m: (m[0], m[1][0] is not None, m[1][0] or 0))
        placed += [((2 * i + 1) / (2.0 * len(members)), key, i, row) for i, (_, row) in enumerate(members)]
    placed.sort(key=lambda p: p[:3])
    out, used = [], Counter()
    for at, (*_, row) in enumerate(placed):
        shard = at * shards // len(placed)
        out.append((*row, shard, used[shard]))
        used[shard] += 1
    return out


@pytest.mark.parametrize("n, shards", [(0, 4), (3, 16), (997, 16), (640, 7)])
def test_against_plain_sorting(spark, monkeypatch, n, shards):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    rows = [(i if i % 50 else None, None if i % 11 == 0 else f"s{min(i % 9, 3)}", i % 5) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int")
    hashes = [r[0] for r in df.selectExpr("xxhash64(9, doc_id)").collect()]
    found = sharding.sharded(df, "source", shards, 9)
    assert found.columns == ["doc_id", "source", "shard", "slot"]
    wanted = plain([r[:2] for r in rows], hashes, shards)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))


def test_query_law_and_mixture(spark, folder):
    from stayline.llm.queries import op8_sharding

    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = op8_sharding(spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    share = Counter((r.shard, docs[r.doc_id].source) for r in found)
    of = Counter(d.source for d in docs.values())
    assert all(abs(share[s, source] - n / 16) <= 2 for source, n in of.items() for s in range(16))
    import zlib

    for r in found:
        data = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_written_shards(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS doc_id", "cast(id % 3 AS string) AS source")
    sharding.write(sharding.sharded(df, "source", 4, 1), str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} == {f"shard={i}" for i in range(4)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
