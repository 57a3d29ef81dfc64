"""A quality classifier from trusted positives and unlabelled web text.

Positive-unlabelled learning: the positives are rows labelled 1, everything else, labelled or not, is an
unlabelled draw from the whole.  The share of positives in that draw (the class prior) is estimated from the
scores of a first positive-against-unlabelled model; then a linear model minimises the non-negative unbiased
risk  p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])  of the logistic loss l.  Negative labels are never used.

What is learned from is bounded: at most ``POSITIVES`` and ``UNLABELLED`` rows, drawn by a seeded hash of
their id over the whole tables; the model is fitted on the driver.  Scoring reads every whole text once.
A score depends on the text alone, by its characters' and words' statistics and hashed word shapes.

Defined cases: a null or empty text has a score too (all its statistics are 0); rows with a null id are
scored, count as not held out and are not learned from; repeated rows are scored each; labels that are null
or repeated count once or not at all; other columns are ignored by ``scores``; an empty table gives an
empty one; without any trusted positive every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that is learned from.
POSITIVES = 4000
UNLABELLED = 8000
SEED = 7
STEPS = 250
RATE = 0.05
DECAY = 1e-3
#: Buckets of hashed word shapes.
SHAPES = 256

#: Bytes to classes: capitals, small letters (and all beyond ASCII), digits; marks stay themselves.
CLASSES = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)
RUN = re.compile(rb"(.)\1+")
LETTERS = b"Aa"
NAMED = 12


def features(text: bytes | None) -> np.ndarray:
    """``NAMED`` statistics of a text, then its shares of hashed word shapes."""
    out = np.zeros(NAMED + SHAPES, np.float32)
    words = text.split() if text else []
    n = len(words)
    if not n:
        return out
    classes = text.translate(CLASSES)
    shapes = Counter(RUN.sub(rb"\1", classes).split())
    letters = classes.count(b"a") + classes.count(b"A")
    size = len(text)
    lines = text.count(b"\n") + 1
    marked = sum(k for s, k in shapes.items() if s[-1:] in b".,;:!?")
    bare = sum(k for s, k in shapes.items() if not s.strip(b"0123456789Aa").strip(LETTERS) and s[:1] not in LETTERS)
    shouting = sum(k for s, k in shapes.items() if s[:1] == b"A" and b"a" not in s)
    out[:NAMED] = (
        np.log1p(n),
        size / n / 10,
        letters / size,
        classes.count(b"0") / size,
        classes.count(b"A") / size,
        marked / n,
        bare / n,
        shouting / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        np.log1p(n / lines),
        (size - letters - n) / n,
    )
    for shape, k in shapes.items():
        out[NAMED + zlib.crc32(shape) % SHAPES] += k / n
    out[NAMED:] = np.sqrt(out[NAMED:])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        g = z @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights by Adam; without a prior, of the plain positive-against-unlabelled risk."""
    p = np.hstack([positive, np.ones((len(positive), 1), np.float32)])
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1), np.float32)])
    w, m, v = (np.zeros(p.shape[1], np.float32) for _ in range(3))
    for step in range(1, STEPS + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        as_positive = p.T @ (sp - 1) / len(p)  # gradients of E+[l(g)], E+[l(-g)], Eu[l(-g)]
        as_negative, of_all = p.T @ sp / len(p), u.T @ su / len(u)
        if prior is None:
            grad = as_positive + of_all
        else:
            rest = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
            grad = prior * as_positive + of_all - prior * as_negative if rest >= 0 else prior * as_negative - of_all
        grad += DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled.

    Above any threshold, the unlabelled share is at least prior times the positive share; the threshold
    with the least upper bound of their quotient is the tightest.
    """
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    w = _fit(positive[:half_p], unlabelled[:half_u], None)
    gp = np.sort(positive[half_p:] @ w[:-1])
    gu = np.sort(unlabelled[half_u:] @ w[:-1])
    cuts = gp[: int(0.9 * len(gp)) + 1]
    share_p = 1 - np.searchsorted(gp, cuts) / len(gp)
    share_u = 1 - np.searchsorted(gu, cuts) / len(gu)
    slack = np.sqrt(np.log(40) / 2 / len(gp)) + np.sqrt(np.log(40) / 2 / len(gu))
    best = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    width = NAMED + SHAPES
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    prior = _prior(p, u)
    return Model(mean, scale, _fit(p, u, prior), prior)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _sample(ids: DataFrame, n: int) -> DataFrame:
    return ids.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(n)


def _rows(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents ``ids`` names, of which there are at most ``UNLABELLED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text).tobytes() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["x"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    found = chosen.select(F.col("text").cast("binary")).mapInArrow(run, "x binary").collect()
    return np.array([np.frombuffer(r["x"], np.float32) for r in found], np.float32).reshape(-1, NAMED + SHAPES)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the rows of ``docs`` that are not held out and ``labels`` (doc_id, quality) of them."""
    known = docs.filter("doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).select("doc_id")
    trusted = labels.filter(F.col("quality") == 1).select("doc_id").distinct()
    positive = _rows(docs, _sample(known.join(trusted, "doc_id", "left_semi").distinct(), POSITIVES))
    return fit(positive, _rows(docs, _sample(known, UNLABELLED)))


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` (none of them named score) and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(np.array([features(t) for t in batch.column(0).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], names)

    plain = [f"c{i}" for i in range(len(columns))]
    names = [*plain, "score"]
    own = [F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain, strict=True)]
    schema = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(columns, plain, strict=True))
    rows = docs.select(F.col("text").cast("binary").alias("whole"), *own)
    return rows.mapInArrow(run, f"{schema}, score double").toDF(*columns, "score")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored(docs, model, ["doc_id"]).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
