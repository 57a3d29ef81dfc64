import gzip
import hashlib
import io
import random

import pytest

from stayline.llm import warc
from stayline.llm.common import small_batches

LONG = "<p>same</p>" * 200


def test_round_trip_of_edge_rows(spark, tmp_path):
    small_batches(spark)
    rows = [
        (1, "http://a/ x", LONG, "clash"), (2, None, LONG, ""), (9, "http://b", LONG, ""), (3, "u", None, ""),
        (4, "u", "", ""), (5, "u", "short", ""), (6, "u", "short", ""), (None, "u", LONG, ""), (7, "é", "ü\r\n\r\n" * 500, ""),
        (9, "http://b", LONG, ""), (8, "u", "é" * 499 + "x", ""), (10, "u", "é" * 499 + "x", ""), (11, "u", "é" * 500, ""),
        (12, "u", "é" * 500, ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    listed = warc.write(pages, str(tmp_path / "w"))
    assert sum(r.records for r in listed.collect()) == len(rows)
    found = warc.read(spark, str(tmp_path / "w")).collect()
    wanted = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        same = [i for i, _, h, _ in rows if (h or "").encode() == data and i is not None]
        revisit = len(data) >= 1000 and page_id != max(same)
        digest = hashlib.sha1(data).hexdigest()
        wanted.append((page_id, "revisit" if revisit else "response", max(same) if revisit else None, len(data), digest))
        wanted[-1] += (None if revisit else data,)
    assert sorted(((r[0], *r[2:6], r[6] and bytes(r[6]) or (b"" if r[6] is not None else None)) for r in found), key=str) == sorted(wanted, key=str)
    for path in (tmp_path / "w").glob("*.warc.gz"):
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: re")


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_members_across_any_chunk(monkeypatch):
    rng = random.Random(2)
    bodies = [rng.randbytes(rng.randint(0, 300)) for _ in range(20)]
    data = b"".join(warc.record(i, "u", b, None, False, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies))
    for chunk in (1, 7, 100, 1 << 16):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert [warc.parse(m)[1] for m in warc.members(io.BytesIO(data))] == bodies
    with pytest.raises(warc.Damaged):
        list(warc.members(io.BytesIO(data[:-5])))


def test_damage_is_found():
    good = next(warc.members(io.BytesIO(warc.record(1, "u", b"payload", None, False, "2024-01-01T00:00:00Z"))))
    warc.parse(good)
    for bad in (good.replace(b"payload", b"pay1oad"), good[:-1], good + b"x", b"HTTP" + good[4:]):
        with pytest.raises(warc.Damaged):
            warc.parse(bad)
