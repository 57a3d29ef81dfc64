"""Nearest neighbours by inner product through low-dimensional stable projections.

Vectors get one more component that makes their lengths equal, so the largest inner product is the least
Euclidean distance.  A Gaussian (2-stable) projection to ``PROJECTED`` dimensions keeps distances in
distribution: the square of the projected distance over the square of the true one is chi-square.

One kd-tree over the projected points, its cuts taken from at most ``SAMPLE`` vectors, deals every vector into
at most ``CELLS`` cells, each with the box of its points; large cells are split into parts by a hash.  A query
visits cells in the order of their boxes' distance, in rounds of 1, 3, 12, 48, ... cells, and a later round only those
whose box may still hold a nearer vector.  Inside a part a second tree hands out points in order of projected
distance, and their vectors are verified until a vector nearer than the k-th found so far, in this part or an
earlier round, would lie beyond the next point with a chance below ``1 - CONFIDENCE``: the next point is farther than
the k-th true distance times the chi-square quantile.  The same test excludes boxes.

A round ships the vectors of visited cells once, and again for every ``QUERY_ROWS`` queries of a cell; what a task holds is
one part, past which its queries stream.  Of equal vectors only the k + 1 smallest ids are indexed: none of the
others can be among anyone's first k, as ties go to smaller ids.

Defined cases: rows without an id, and vectors that are null, zero, of another dimension than most, or
hold null or non-finite components take no part; repeated rows count once; other columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import staged

PROJECTED = 32
CONFIDENCE = 0.94
#: Vectors that the cuts between cells are taken from, and the most cells there are.
SAMPLE = 16_384
CELLS = 1024
#: Aimed at: vectors of a cell, while there are fewer than ``CELLS``.
CELL_ROWS = 2048
#: Aimed at: vectors of a part of a cell, and queries that meet one copy of it.
PART_ROWS = 16_384
QUERY_ROWS = 32_768
LEAF = 128
#: Points verified between two tests.
STEP = 32
SEED = 11


def chi_square(p: float, dimensions: int) -> float:
    """The quantile, by the cube-root normal approximation."""
    a = 2 / (9 * dimensions)
    return dimensions * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def _widest(points: np.ndarray) -> int:
    return int((points.max(axis=0) - points.min(axis=0)).argmax())


def _gaps(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    return (np.maximum(0, np.maximum(low - point, point - high)) ** 2).sum(axis=1)


@dataclass
class Space:
    """What all tasks share: the projection, and the cuts between cells as a full binary tree in heap order."""

    width: int
    longest: float
    axes: np.ndarray
    cuts: np.ndarray

    @property
    def plane(self) -> np.ndarray:
        return np.random.default_rng(SEED).normal(size=(self.width + 1, PROJECTED))

    def points(self, vectors: np.ndarray) -> np.ndarray:
        plane = self.plane
        rest = np.sqrt(np.maximum(self.longest - (vectors**2).sum(axis=1), 0))
        return vectors @ plane[:-1] + rest[:, None] * plane[-1]

    def asked(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.plane[:-1]

    def reach(self, own: np.ndarray | float, score: np.ndarray | float) -> np.ndarray | float:
        """Squared projected distance that a vector better than ``score`` stays within, for a query of square length ``own``."""
        return (own + self.longest - 2 * score) * chi_square(CONFIDENCE, PROJECTED)

    def cells(self, points: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(len(self.axes).bit_length()):
            node = 2 * node + 1 + (points[every, self.axes[node]] >= self.cuts[node])
        return node - len(self.axes)

    def cut(self, sample: np.ndarray, depth: int) -> Space:
        """With ``depth`` levels of cuts at the medians of a sample's points."""
        axes, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        rows = {0: self.points(sample)}
        for node in range(len(axes)):
            own = rows.pop(node)
            if len(own):
                axes[node] = _widest(own)
                cuts[node] = np.median(own[:, axes[node]])
            right = own[:, axes[node]] >= cuts[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
        return Space(self.width, self.longest, axes, cuts)


class Block:
    """A kd-tree over the projections of a part's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, space: Space):
        points = space.points(vectors)
        leaves, todo = [], [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            cut = np.argpartition(points[rows, _widest(points[rows])], len(rows) // 2)
            todo += [rows[cut[: len(rows) // 2]], rows[cut[len(rows) // 2 :]]]
        self.ids, self.vectors, self.points, self.leaves, self.space = ids, vectors, points, leaves, space
        self.low = np.array([points[rows].min(axis=0) for rows in leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in leaves])
        self.verified = 0

    def neighbours(self, point: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and their squared projected distances, nearest first, as boxes are opened."""
        boxes = _gaps(self.low, self.high, point)
        order = np.argsort(boxes, kind="stable")
        rows, distances = np.empty(0, np.int64), np.empty(0)
        for leaf, beyond in zip(order, [*boxes[order[1:]], np.inf], strict=True):
            rows = np.append(rows, self.leaves[leaf])
            distances = np.append(distances, ((self.points[self.leaves[leaf]] - point) ** 2).sum(axis=1))
            near = distances <= beyond
            if near.any():
                at = np.argsort(distances[near], kind="stable")
                yield rows[near][at], distances[near][at]
                rows, distances = rows[~near], distances[~near]

    def search(
        self, query_id: int, query: np.ndarray, k: int, point: np.ndarray, floor: float = -np.inf
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k nearest found that reach ``floor``, but the query's own row."""
        own = float((query**2).sum())
        ids, scores = np.empty(0, np.int64), np.empty(0)
        for rows, distances in self.neighbours(point):
            for at in range(0, len(rows), STEP):
                if distances[at] > self.space.reach(own, floor):
                    return ids, scores
                some = rows[at : at + STEP]
                self.verified += len(some)
                found = (self.vectors[some] * query).sum(axis=1)  # the same sum for equal vectors, wherever they are
                good = (self.ids[some] != query_id) & (found >= floor)
                if good.any():
                    ids, scores = np.append(ids, self.ids[some][good]), np.append(scores, found[good])
                    order = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[order], scores[order]
                    if len(ids) == k:
                        floor = max(floor, float(scores[-1]))
        return ids, scores


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    sizes = rows.filter("v IS NOT NULL").groupBy(F.size("v").alias("n")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    true = (F.size("v") == (most["n"] if most else 0)) & finite & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(true).distinct()


def _array(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _space(indexed: DataFrame, n: int) -> Space:
    """The projection and the cuts, from the longest vector and a sample drawn by a hash of the id."""
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    facts = indexed.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("longest")).first()
    space = Space(facts["width"], facts["longest"], np.zeros(0, np.int64), np.zeros(0))
    depth = (min(CELLS, max(1, n // CELL_ROWS)) - 1).bit_length()
    if not depth:
        return space
    sample = indexed.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    return space.cut(np.concatenate([_array(b) for b in sample.to_batches()]), depth)


def _placed(indexed: DataFrame, space: Space) -> DataFrame:
    """Adds cell."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = space.cells(space.points(_array(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], ["vec_id", "v", "cell"])

    return indexed.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, cell long")


def _boxes(placed: DataFrame, space: Space) -> list[Row]:
    """cell, n, low, high of the cells that hold vectors, at most ``CELLS``; one row per task and cell is shuffled."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cells, points = batch.column("cell").to_numpy(), space.points(_array(batch))
            for cell in np.unique(cells).tolist():
                own = points[cells == cell]
                n, low, high = known.get(cell, (0, own[0], own[0]))
                known[cell] = n + len(own), np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))
        rows = [{"cell": c, "n": n, "low": a.tolist(), "high": b.tolist()} for c, (n, a, b) in known.items()]
        yield pa.RecordBatch.from_pylist(rows, schema)

    ends = [(name, pa.list_(pa.float64())) for name in ("low", "high")]
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64()), *ends])
    found = placed.mapInArrow(bound, "cell long, n long, low array<double>, high array<double>")
    low = F.array(*(F.min(F.col("low")[i]) for i in range(PROJECTED))).alias("low")
    high = F.array(*(F.max(F.col("high")[i]) for i in range(PROJECTED))).alias("high")
    return found.groupBy("cell").agg(F.sum("n").alias("n"), low, high).orderBy("cell").collect()


def _requests(asked: DataFrame, space: Space, boxes: list[Row], done: int, until: int) -> DataFrame:
    """query_id, cell, floor: of each query's cells from the ``done``-th to the ``until``-th those it must still visit.

    ``asked`` has vec_id, v and floor, the k-th score so far or null.
    """
    cells = np.array([b["cell"] for b in boxes], np.int64)
    low, high = np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = _array(batch)
            floors = batch.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
            reach = space.reach((queries**2).sum(axis=1), floors)
            rows, chosen = [], []
            for i, point in enumerate(space.asked(queries)):
                gaps = _gaps(low, high, point)
                order = np.argsort(gaps, kind="stable")[done:until]
                order = order[gaps[order] <= reach[i]]
                rows.append(np.full(len(order), i))
                chosen.append(cells[order])
            at = np.concatenate(rows)
            columns = [batch.column("vec_id").take(at), pa.array(np.concatenate(chosen)), pa.array(floors[at])]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "cell", "floor"])

    return asked.select("vec_id", "v", "floor").mapInArrow(choose, "query_id long, cell long, floor double")


def _searched(rows: DataFrame, space: Space, k: int, verified: Accumulator | None) -> DataFrame:
    """query_id, vec_id, score from rows (cell, part, grp, asks, id, v, floor): vectors, and the queries that visit them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "grp", "asks")])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                *key, asks = keys[:, start].tolist()
                some = batch.slice(start, end - start)
                ids, vectors = some.column("id").to_numpy(), _array(some)
                if key != here:
                    here, held, block = key, [], None
                if not asks:
                    held.append((ids, vectors))
                    continue
                if block is None and held:
                    block = Block(*(np.concatenate(c) for c in zip(*held, strict=True)), space)
                    held = []
                if block:
                    yield answers(block, ids, vectors, some.column("floor").to_numpy())

    def answers(block: Block, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> pa.RecordBatch:
        before, out = block.verified, []
        for query_id, query, point, floor in zip(ids, queries, space.asked(queries), floors, strict=True):
            found, scores = block.search(query_id, query, k, point, floor)
            out.append((np.full(len(found), query_id), found, scores))
        if verified is not None:
            verified.add(block.verified - before)
        columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return rows.mapInArrow(search, "query_id long, vec_id long, score double")


def _visits(placed: DataFrame, requests: DataFrame, asked: DataFrame, boxes: list[Row]) -> DataFrame:
    """The visited cells' vectors and the queries that visit them, (cell, part, grp) by (cell, part, grp), vectors first."""
    parts = placed.sparkSession.createDataFrame([(b["cell"], b["n"] // PART_ROWS + 1) for b in boxes], "cell long, parts long")
    cells = requests.groupBy("cell").agg((F.floor(F.count(F.lit(1)) / QUERY_ROWS) + 1).alias("groups")).join(parts, "cell")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))
    vectors = placed.join(cells, "cell").select(
        "cell", F.expr("pmod(xxhash64(vec_id), parts)").alias("part"), every.alias("grp"), F.lit(0).alias("asks"),
        F.col("vec_id").alias("id"), "v", F.lit(0.0).alias("floor"),
    )
    queries = requests.join(cells, "cell").join(asked.select(F.col("vec_id").alias("query_id"), "v"), "query_id").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.expr("pmod(xxhash64(query_id), groups)").alias("grp"), F.lit(1).alias("asks"),
        F.col("query_id").alias("id"), "v", "floor",
    )
    key = ["cell", "part", "grp"]
    return vectors.union(queries).repartition(*key).sortWithinPartitions(*key, "asks")


def nearest(rows: DataFrame, queries: DataFrame, k: int, verified: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``rows`` (vec_id, embedding) to ``queries``, which are rows of it.

    ``verified`` counts the vectors that were verified, over all queries.
    """
    base = staged(_vectors(rows), "vectors")
    order = Window.partitionBy("v").orderBy("vec_id")
    indexed = base.withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= k + 1).drop("copy")
    n = base.count()
    if not n:
        return base.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0D AS score").limit(0)
    space = _space(base, n)
    placed = staged(_placed(indexed, space), "placed")
    boxes = _boxes(placed, space)
    asked = staged(base.join(queries.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi"), "asked")
    best, done, until = None, 0, 1
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    while done < len(boxes):
        if best is None:
            floors = asked.withColumn("floor", F.lit(None).cast("double"))
        else:
            last = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
            floors = asked.join(last, "vec_id", "left")
        requests = staged(_requests(floors, space, boxes, done, until), "requests")
        if requests.isEmpty():
            break
        found = _searched(_visits(placed, requests, asked, boxes), space, k, verified)
        if best is not None:
            found = found.union(best.select("query_id", "vec_id", "score"))
        best = staged(found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k), "best")
        done, until = until, 4 * until
    if best is None:
        return base.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0D AS score").limit(0)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
