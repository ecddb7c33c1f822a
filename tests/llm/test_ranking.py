"""The Bradley-Terry fit against its loss, searched and differentiated, and its threshold against a weighted count."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import quality


def sample(seed, n=300, features=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features)) * np.array([1, 5, 0.1, 2]) + 3
    true = np.array([1.5, -0.4, 8.0, 0.0])
    label = (1 / (1 + np.exp(-(x - 3) @ true)) > rng.random(n)).astype(int)
    return x, label


def pairs_of(x, label, plan):
    """The differences that the fit draws, and its features' scale."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(plan.seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    return z, z[rng.choice(good, plan.pairs)] - z[rng.choice(bad, plan.pairs)]


@pytest.mark.parametrize("seed", range(4))
def test_fit(seed):
    x, label = sample(seed)
    plan = quality.RankPlan()
    model = quality.fit(x, label, label.mean(), plan)
    z, d = pairs_of(x, label, plan)
    loss = lambda w: np.logaddexp(0, -d @ w).sum() + plan.ridge / 2 * w @ w  # noqa: E731  of each preference that it gets wrong, and the ridge
    least = loss(model.weights)
    for k in range(len(model.weights)):  # the slope is none in any direction, and the loss is convex
        step = np.zeros(len(model.weights))
        step[k] = 1e-4
        assert abs(loss(model.weights + step) - loss(model.weights - step)) / 2e-4 < 1e-2
    rng = np.random.default_rng(seed)
    w = np.zeros(len(model.weights))
    for _ in range(4000):  # a search that knows nothing of derivatives doesn't get below it
        other = w + rng.normal(size=len(w)) * 0.2
        w = other if loss(other) < loss(w) else w
    assert least <= loss(w) + 1e-6 and np.abs(w - model.weights).max() < 0.6
    order = np.argsort(-model.utilities(x))
    assert label[order[:50]].mean() > 0.9 and label[order[-50:]].mean() < 0.1


@pytest.mark.parametrize("share", [0.1, 0.5, 0.8])
def test_threshold(share):
    """With the rows weighed as all labels are, a score of one half parts them by the share of label 1."""
    x, label = sample(9)
    model = quality.fit(x, label, share)
    each = np.where(label == 1, share / (label == 1).sum(), (1 - share) / (label == 0).sum())
    above = each[model.scores(x) >= 0.5].sum()
    assert abs(above - share) <= 2 * each.max() + 1e-9
    assert ((model.scores(x) >= 0.5) == (model.utilities(x) >= model.threshold)).all()


def test_one_kind_only():
    x, _ = sample(1)
    assert quality.fit(x, np.ones(len(x), int), 1.0) is None and quality.fit(x[:0], np.zeros(0, int), 0.5) is None
    same = quality.fit(np.ones((10, 3)), np.array([0, 1] * 5), 0.5)
    assert np.isfinite(same.weights).all() and same.scores(np.ones((2, 3))).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("n", [300, 9000])
def test_train_on_all_pairs(spark, n):
    """The weights have the least loss over all pairs of all labelled rows, and as many rows as are labelled 1 score one half or more."""
    x, label = sample(n, n)
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(n, [0.0] * x.shape[1])], "doc_id long, x array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(q)) for i, q in enumerate(label)] + [(n, None), (n, 2), (None, 1), (n + 7, 1)], "doc_id long, quality int")
    plan = quality.RankPlan()
    model = quality.train(vectors, labels, F.col("doc_id") >= 0, plan)
    assert np.allclose(model.mean, x.mean(0), rtol=1e-9) and np.allclose(model.scale, x.std(0) + 1e-6, rtol=1e-9)
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    good, bad = z[label == 1], z[label == 0]
    each = plan.pairs / (len(good) * len(bad))

    def slope(w):
        lost = 1 / (1 + np.exp(good @ w[:, None] - (bad @ w)[None, :]))
        return each * (good.T @ lost.sum(1) - bad.T @ lost.sum(0)) - plan.ridge * w

    assert np.abs(slope(model.weights)).max() < 1e-4 * np.abs(slope(np.zeros(x.shape[1]))).max()
    assert (model.scores(x) >= 0.5).sum() == label.sum()


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_middle(spark, most):
    rng = np.random.default_rng(most)
    for values in (rng.normal(size=60), rng.integers(0, 4, 60) / 3, np.ones(5), np.array([1.0, np.nextafter(1, 2), 1e9])):
        u = spark.createDataFrame([(float(v),) for v in values], "u double").coalesce(2)
        ordered = np.sort(values)
        for rank in {0, len(values) // 3, len(values) - 2}:
            assert quality.middle(u, rank, 5, most) == (ordered[rank] + ordered[rank + 1]) / 2
