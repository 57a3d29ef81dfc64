import zlib

import numpy as np
import pytest

from stayline.llm import quality_model as q
from stayline.llm.common import small_batches


def test_prior_and_risk_on_two_clouds():
    rng = np.random.default_rng(1)
    width = q.NAMED + q.SHAPES

    def cloud(n, centre):
        x = rng.normal(0, 1, (n, width)).astype(np.float32) * 0.1
        x[:, :3] += centre
        x[:, q.NAMED :] = 0
        return x

    for share in (0.3, 0.8):
        n = int(2000 * share)
        unlabelled = rng.permutation(np.vstack([cloud(n, 1.0), cloud(2000 - n, -1.0)]))
        model = q.fit(cloud(800, 1.0), unlabelled)
        assert abs(model.prior - share) < 0.08
        assert (model.score(cloud(300, 1.0)) > 0.5).mean() > 0.95 < (model.score(cloud(300, -1.0)) < 0.5).mean()


def plain_risk(w, positive, unlabelled, prior):
    """The non-negative unbiased risk, summed row by row, with the decay that the fit adds."""

    def loss(g):
        return np.log1p(np.exp(-abs(g))) + max(-g, 0.0)

    def mean(rows, sign):
        return sum(loss(sign * (sum(a * b for a, b in zip(w, x, strict=False)) + w[-1])) for x in rows) / len(rows)

    rest = mean(unlabelled, -1) - prior * mean(positive, -1)
    decay = q.DECAY / 2 * sum(a * a for a in w[:-1])
    return prior * mean(positive, 1), rest, decay


def test_fit_follows_the_risk_of_a_plain_computation(monkeypatch):
    """Adam over numeric gradients of the plain risk ends where the fit ends, also where the correction takes over."""
    rng = np.random.default_rng(2)
    positive = rng.normal(0.7, 1, (40, 2)).astype(np.float32)
    unlabelled = rng.normal(0, 1, (60, 2)).astype(np.float32)
    monkeypatch.setattr(q, "STEPS", 60)
    turned = 0
    for prior in (0.3, 0.95):
        w, m, v, step = np.zeros(3), np.zeros(3), np.zeros(3), 1e-5
        for t in range(1, q.STEPS + 1):
            _, rest, _ = plain_risk(w, positive, unlabelled, prior)
            turned += rest < 0

            def value(x, rest=rest, prior=prior):
                held, other, decay = plain_risk(x, positive, unlabelled, prior)
                return (held + other if rest >= 0 else -other) + decay

            grad = np.array([(value(w + step * e) - value(w - step * e)) / (2 * step) for e in np.eye(3)])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - q.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        assert np.abs(q._fit(positive, unlabelled, prior) - w).max() < 0.02, prior
    print("steps with a negative part:", turned)


def test_edge_rows(spark):
    small_batches(spark)
    rows = [(1, "good text.", 0.0), (2, None, 1.0), (None, "x", 2.0), (3, "", 3.0), (3, "", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, quality int")
    model = q.train(docs, labels)
    found = q.scores(docs, model).collect()
    assert len(found) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in found)
    assert {r.doc_id: r.held_out for r in found} == {
        i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 3, None)
    }
    assert q.scores(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("sf", ["0.01"])
def test_held_out_accuracy_of_the_query(spark, sf):
    from stayline.llm.queries import op5_quality_model

    folder = f"/root/testdata/sf{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = op5_quality_model(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (good >= 0.5).mean() > 0.95 and (bad >= 0.5).mean() < 0.1
