import numpy as np
import pytest

from stayline.llm import nearest
from stayline.llm.common import small_batches


def exact(ids, vectors, query, own, k):
    scores = (vectors * query).sum(axis=1)
    rows = sorted((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if i != own)
    return [(i, -s) for s, i in rows[:k]]


@pytest.fixture
def cloud():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 16)) * rng.uniform(0.2, 2, (900, 1))
    vectors[600:] = vectors[0]  # a third of all rows are copies
    vectors[300:330] = vectors[1]
    return list(range(900)), vectors.astype(np.float32).astype(np.float64)


def block_of(ids, vectors):
    longest = float((vectors**2).sum(axis=1).max())
    return nearest.Block(np.array(ids), vectors, nearest.Space(vectors.shape[1], longest, np.zeros(0, np.int64), np.zeros(0)))


def test_recall_over_cells_parts_and_groups(spark, monkeypatch, cloud):
    small_batches(spark)
    monkeypatch.setattr(nearest, "CELL_ROWS", 100)
    monkeypatch.setattr(nearest, "PART_ROWS", 40)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 7)
    monkeypatch.setattr(nearest, "LEAF", 16)
    ids, vectors = cloud
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, v string")
    found = {}
    for r in nearest.nearest(rows, rows.filter("vec_id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 900, 20):
        wanted = exact(ids, vectors, vectors[q], q, 10)
        assert len(found[q]) == 10 and q not in [i for i, _ in found[q]]
        assert all(abs(s - float((vectors[i] * vectors[q]).sum())) < 1e-12 for i, s in found[q])
        assert found[q] == sorted(found[q], key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in wanted} & {i for i, _ in found[q]})
    assert hits / (45 * 10) > 0.95


def test_neighbours_come_in_order_of_distance(cloud):
    ids, vectors = cloud
    block = block_of(ids, vectors)
    point = block.points[5] + 0.1
    rows, distances = (np.concatenate(c) for c in zip(*block.neighbours(point), strict=True))
    assert sorted(rows.tolist()) == ids
    assert (np.diff(distances) >= 0).all()


def test_search_stops_before_the_end_in_clusters():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 5
    vectors = np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 0.1
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    block = block_of(range(4000), vectors)
    block.search(-1, vectors[7], 10, block.space.asked(vectors[7]))
    assert 0 < block.verified < 400


def test_every_point_lies_in_its_cell():
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(3000, 16))
    whole = nearest.Space(16, float((vectors**2).sum(axis=1).max()), np.zeros(0, np.int64), np.zeros(0))
    space = whole.cut(vectors[:1000], 4)
    cells = space.cells(space.points(vectors))
    assert set(cells.tolist()) == set(range(16))
    assert 100 < np.bincount(cells).min() and np.bincount(cells).max() < 300
    assert whole.cells(vectors).max() == 0
    assert space.cut(vectors[:1], 3).cells(space.points(vectors)).max() < 8  # fewer vectors than cells


def noisy(vectors, copies):
    rng = np.random.default_rng(8)
    out = np.concatenate([vectors + rng.normal(size=vectors.shape) * 0.05 for _ in range(copies)])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


@pytest.mark.parametrize("copies", [1, 8])
def test_search_stops_before_the_end_on_the_given_table(spark, copies):
    """Through the whole search: the share of vectors verified, and the recall; with copies, over several cells and rounds."""
    small_batches(spark)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    vectors = np.array([r.embedding for r in rows], np.float64)
    vectors = vectors if copies == 1 else noisy(vectors, copies)
    ids = list(range(len(vectors)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    verified, found = spark.sparkContext.accumulator(0), {}
    for r in nearest.nearest(df, df.filter("vec_id % 80 = 0"), 20, verified).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = range(0, len(ids), 80)
    hits = sum(len({n for n, _ in exact(ids, vectors, vectors[i], i, 20)} & found[i]) for i in asked)
    share, recall = verified.value / (len(asked) * len(ids)), hits / (20 * len(asked))
    print(f"verified {share:.3f}, recall {recall:.3f}")
    assert share < 0.6 and recall >= 0.95


def test_edge_rows(spark):
    small_batches(spark)
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]),
        (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (20, [2.0, 2.0]), (40, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in nearest.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect())
    assert found == [(0, 1, 20, 2.0), (0, 2, 8, 1.0), (0, 3, 1, 0.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 8, 2.0)]
    assert nearest.nearest(df.limit(0), df.limit(0), 3).count() == 0


def test_recall_of_the_query(spark, folder):
    from stayline.llm.queries import op4_nearest

    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    found = {}
    for r in op4_nearest(spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [i for i, v in enumerate(ids) if v % 20 == 0]
    assert set(found) == {ids[i] for i in asked}
    hits = sum(len({n for n, _ in exact(ids, vectors, vectors[i], ids[i], 20)} & found[ids[i]]) for i in asked)
    assert hits / (20 * len(asked)) >= 0.95
