"""Queries as they are registered, against their SQL or a plain computation."""

import zlib

import duckdb
import pytest

from stayline.llm import queries as q


@pytest.mark.parametrize("name, tables", [("op7_warc", ["pages"]), ("op10_quality_rules", ["documents"])])
def test_against_sql(spark, folder, name, tables):
    found = q.QUERIES[name](spark, folder)
    connection = duckdb.connect()
    for table in tables:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    wanted = connection.sql(q.ORACLES[name])
    assert set(found.columns) == set(wanted.columns)
    rows = map(tuple, found.select(wanted.columns).collect())
    assert sorted(map(str, rows)) == sorted(map(str, wanted.fetchall()))


def test_packing_covers_every_document(spark, folder):
    rows = sorted(q.op9_packing(spark, folder).collect(), key=lambda r: (r.sequence_id, r.offset))
    ends, pieces = {}, {}
    for r in rows:
        assert r.offset == ends.get(r.sequence_id, 0) and r.length > 0
        ends[r.sequence_id] = r.offset + r.length
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert max(ends.values()) <= q.SEQUENCE
    for parts in pieces.values():
        parts.sort()
        assert [p[:2] for p in parts] == [(i, i * q.SEQUENCE) for i in range(len(parts))]
    assert set(pieces) == {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}


def test_sharding_of_null_and_empty_texts(spark, tmp_path):
    texts = [None, "", "é", "same", "same"] * 20
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = q.op8_sharding(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in found} == {
        i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows
    }
    shards = {}
    for r in found:
        assert r.law == "rows" and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) == set(range(q.SHARDS)) and len(found) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
