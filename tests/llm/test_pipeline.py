import duckdb
import numpy as np
import pytest
from test_simhash import plain_components, plain_fingerprint
from test_substrings import plain

import corpus_pipeline as pipeline
from stayline.llm.queries import END_ID, OP10_SQL, SEQUENCE, WORD_VOCABULARY
from stayline.llm.wordpiece import WhiteSpaceEncoder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out.append((docs.collect(), spark.read.parquet(path).collect()))
        docs = spark.read.parquet(path)
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_columns_stay(steps):
    for before, after in steps[:-1]:
        assert after and list(after[0].asDict()) == list(before[0].asDict())
        assert all(r.n_chars == len(r.text) for r in after)


def test_quality_keeps_the_good(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = (by_id(x) for x in steps[0])
    assert all(after[i] == before[i] for i in after)
    good = [i for i in before if labels.get(i) == 1]
    bad = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in good) >= 0.9 * len(good) and sum(i in after for i in bad) <= 0.1 * len(bad)


def test_rules_against_sql(steps):
    before, after = steps[1]
    import pandas as pd

    documents = pd.DataFrame({"doc_id": [r.doc_id for r in before], "text": [r.text for r in before]})
    connection = duckdb.connect()
    connection.register("documents", documents)
    kept = {r[0] for r in connection.sql(f"SELECT doc_id FROM ({OP10_SQL}) WHERE kept").fetchall()}
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == kept
    assert all(set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n")) for r in after)


def test_near_duplicates_against_brute_force(steps):
    before, after = steps[2]
    fps = {r.doc_id: plain_fingerprint(r.text) for r in before}
    tops = plain_components(set(fps.values()))
    first = {}
    for i, f in fps.items():
        first[tops[f]] = min(first.get(tops[f], i), i)
    assert by_id(after) == {i: by_id(before)[i] for i in first.values()}


def test_passages_against_brute_force(steps):
    before, after = (sorted(x) for x in steps[3])
    wanted = plain([(r.doc_id, r.text) for r in before], 20)
    assert [r.text for r in after] == [k if gone else r.text for r, (_, gone, k) in zip(before, wanted, strict=True)]


def test_packed_covers_every_token(steps):
    before, after = steps[4]
    own, at = WhiteSpaceEncoder(WORD_VOCABULARY), {}
    for r in sorted(after, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == at.get(r.doc_id, 0) == r.piece * SEQUENCE
        at[r.doc_id] = r.start + r.length
    assert at == {r.doc_id: len(own.whole(r.text) + [END_ID]) for r in before}
    bins = {}
    for r in after:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        lengths = [n for _, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == (np.cumsum([0, *lengths[:-1]])).tolist() and sum(lengths) <= SEQUENCE
    assert len(bins) <= sum(at.values()) / SEQUENCE * 1.05 + 1


def test_edge_rows_through_every_stage(spark):
    prose = " ".join(f"Word{i} goes here." for i in range(40))
    rows = [(1, prose, "a"), (1, prose, "a"), (2, prose, "b"), (None, prose, "c"), (3, None, "d"), (4, "", "e"), (5, "x " * 9000, "f")]
    schema = "doc_id long, text string, score string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        empty = docs.isEmpty()
        for _, stage in pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            if stage is not pipeline.packed:
                assert out.columns == ["doc_id", "text", "score"]
            assert (out.count() == 0) >= empty
