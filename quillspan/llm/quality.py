"""Document quality by Bradley-Terry pairwise ranking.

A document's utility is linear in standardised text features. Every pair of a document labelled 1 and one labelled 0, of all that
may teach, is a preference: the probability that the first wins is the logistic function of the utilities' difference. Weights are
fitted by Newton steps on the logistic loss of all pairs. The threshold is the quantile of all learned utilities that leaves the
preferred share above it; scores are the logistic of the distance to it.

The pairs are never made. What a row adds to the slope depends on its utility and on how many rows of the other label have which
utility, so that a step needs the rows' counts and sums of features by utility only: by 1/64, a row shared between the two
grid points about it, which leaves a probability off by 1e-5 at most. The curvature, which only tells how long a step is, is taken by 1/2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import durable, pick

FEATURES = [
    "length", "word_length", "upper", "digit", "space", "letter", "stop", "comma", "bang", "bar", "hash", "star", "percent", "dollar", "amp", "other",
    "distinct", "adjacent", "line_repeats", "line_length", "odd_ends", "long_words",
]


@dataclass(frozen=True)
class RankPlan:
    """pairs: how many pairs all of them count for against the ridge, and how many fit() draws; ridge: weight decay; steps: Newton steps at most, which end once none moves a weight by 1e-6; seed: of fit()."""

    pairs: int = 60_000
    ridge: float = 20.0
    steps: int = 40
    seed: int = 11


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; null and empty texts have all zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digit = c[97:123].sum(), c[65:91].sum(), c[48:58].sum()
    high = c[128:].sum()
    space = c[32] + c[9:14].sum()
    words = raw.split()
    m = max(1, len(words))
    lines = raw.split(b"\n")
    rate = lambda x: float(np.log1p(100.0 * x / n))
    known = sum(int(c[ord(x)]) for x in "!|#*%$&.,")
    return [
        float(np.log1p(n)), float(n - space) / m, rate(upper), rate(digit), rate(space), (lower + upper + high) / n, rate(c[46]), rate(c[44]), rate(c[33]), rate(c[124]), rate(c[35]), rate(c[42]), rate(c[37]), rate(c[36]), rate(c[38]),
        rate(n - lower - upper - digit - high - space - known), len(set(words)) / m**0.85, sum(map(eq, words, words[1:])) / m, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        sum(w[-1] in b"!|#*%$&" for w in words) / m, sum(len(w) > 20 for w in words) / m,
    ]


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def utilities(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold - self.utilities(x), -60, 60)))


def fit(x: np.ndarray, label: np.ndarray, share: float, plan: RankPlan = RankPlan()) -> Ranker | None:
    """Bradley-Terry weights of rows in memory, from drawn pairs of a row labelled 1 and one labelled 0; None without both. share: how many of all are 1."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(plan.seed)
    d = z[rng.choice(good, plan.pairs)] - z[rng.choice(bad, plan.pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(plan.steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))  # of losing
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + plan.ridge * np.eye(len(w)), d.T @ p - plan.ridge * w)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    u = z @ w
    each = np.where(label == 1, share / len(good), (1 - share) / len(bad))  # the sample's rows weighed as all labels are
    order = np.argsort(u)
    below = np.cumsum(each[order])
    k = int(np.searchsorted(below, 1 - share))
    low, high = u[order[max(0, min(k, len(u) - 1))]], u[order[min(k + 1, len(u) - 1)]]
    return Ranker(mean, scale, w, float((low + high) / 2))


def _totals(rows: DataFrame, vectors: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """The sums by key of the vectors that batches of rows (quality, x) give, over all rows. Each task sums, tasks are summed in order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for key, v in vectors(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)):
                    total[key] = total[key] + v if key in total else v
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()), *_columns(total)], names=["task", "key", "v"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for key, v in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                v = v.values.to_numpy()
                total[key] = total[key] + v if key in total else v
        yield pa.RecordBatch.from_arrays(_columns(total), names=["key", "v"])

    sums = rows.select("quality", "x").mapInArrow(each, "task int, key long, v array<double>").repartition("key").sortWithinPartitions("key", "task").mapInArrow(together, "key long, v array<double>")
    return {r["key"]: np.array(r["v"]) for r in sums.collect()}


def _columns(total: dict[int, np.ndarray]) -> list[pa.Array]:
    return [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))]


FINE, COARSE = 64, 2  # grid points a unit of utility


def _by_utility(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    """Of rows: counts and sums of features by label and point of the fine grid; with sums of products by label and coarse interval. Keys: ((point * 2) + label) * 2 + whether coarse."""

    def vectors(label: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        z = np.clip((x - mean) / scale, -6, 6)
        one = np.concatenate([np.ones((len(z), 1)), z], 1)
        u = (z @ w) * FINE
        point = np.floor(u).astype(np.int64)
        above = (u - point)[:, None]
        keys = (np.concatenate([point, point + 1]) * 2 + np.tile(label, 2)) * 2
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        yield from zip(keys[order][starts].tolist(), np.add.reduceat(np.concatenate([one * (1 - above), one * above])[order], starts), strict=True)
        keys = (np.floor(u * (COARSE / FINE)).astype(np.int64) * 2 + label) * 2 + 1
        for key in np.unique(keys).tolist():
            yield key, (one[keys == key].T @ one[keys == key]).ravel()

    return vectors


def _newton(total: dict[int, np.ndarray], w: np.ndarray, weight: float, ridge: float) -> np.ndarray:
    """The Newton step from w, over all pairs, each of so much weight, of the rows that _by_utility summed."""

    def side(label: int, coarse: int) -> tuple[np.ndarray, np.ndarray]:
        keys = sorted(k for k in total if k & 1 == coarse and k >> 1 & 1 == label)
        return np.array([k >> 2 for k in keys], float) / (COARSE if coarse else FINE), np.array([total[k] for k in keys])

    (good, g), (bad, b) = side(1, 0), side(0, 0)
    slope = -ridge * w
    for k in range(0, len(good), 512):
        lost = 1 / (1 + np.exp(np.clip(good[k : k + 512, None] - bad, -60, 60)))
        some = g[k : k + 512]
        slope = slope + weight * (some[:, 1:].T @ (lost @ b[:, 0]) - b[:, 1:].T @ (lost.T @ some[:, 0]))
    (good, g), (bad, b) = side(1, 1), side(0, 1)
    lost = 1 / (1 + np.exp(np.clip(good[:, None] - bad, -60, 60)))
    each = lost * (1 - lost)
    size = len(w) + 1
    g, b = g.reshape(-1, size, size), b.reshape(-1, size, size)
    cross = g[:, 0, 1:].T @ each @ b[:, 0, 1:]
    curve = np.tensordot(each @ b[:, 0, 0], g[:, 1:, 1:], 1) + np.tensordot(each.T @ g[:, 0, 0], b[:, 1:, 1:], 1) - cross - cross.T
    return np.linalg.solve(weight * curve + ridge * np.eye(len(w)), slope)


def middle(values: DataFrame, rank: int, parts: int = 1024, most: int = 10_000) -> float:
    """Halfway between the value of this rank, from 0, and the next of column u; at most `most` values are collected, once so few are left about it."""
    low, high, inside = values.agg(F.min("u"), F.max("u"), F.count("u")).first()
    before, above = 0, high
    while inside > most and low < high:
        part = F.least(F.floor((F.col("u") - low) / ((high - low) / parts)), F.lit(parts - 1))
        found = values.where(F.col("u").between(low, high)).groupBy(part.alias("part")).agg(F.count("u").alias("n"), F.min("u").alias("low"), F.max("u").alias("high")).orderBy("part").collect()
        for k, r in enumerate(found):
            if rank < before + r["n"]:
                break
            before += r["n"]
        low, high, inside = r["low"], r["high"], r["n"]
        above = found[k + 1]["low"] if k + 1 < len(found) else above
    left = [low] * inside if low == high else sorted(r[0] for r in values.where(F.col("u").between(low, high)).select("u").collect())
    return (left[rank - before] + [*left, above][rank + 1 - before]) / 2


def train(vectors: DataFrame, labels: DataFrame, learn: Column, plan: RankPlan = RankPlan()) -> Ranker | None:
    """Fit on all labelled rows of vectors (doc_id, x) where `learn` (of doc_id) holds; None without both labels."""
    known = pick(labels, doc_id="doc_id", quality="quality").where("quality in (0, 1) and doc_id is not null").where(learn)
    rows = durable(vectors.join(known, "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), "x"))
    # key: the label
    total = _totals(rows, lambda label, x: ((q, np.concatenate([[(label == q).sum()], x[label == q].sum(0)])) for q in (0, 1)))
    n = [int(total[q][0]) if q in total else 0 for q in (0, 1)]
    if not min(n):
        return None
    mean = (total[0][1:] + total[1][1:]) / sum(n)
    scale = np.sqrt(_totals(rows, lambda _, x: iter([(0, ((x - mean) ** 2).sum(0))]))[0] / sum(n)) + 1e-6
    w = np.zeros(len(mean))
    for _ in range(plan.steps):
        step = _newton(_totals(rows, _by_utility(mean, scale, w)), w, plan.pairs / (n[0] * n[1]), plan.ridge)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    model = Ranker(mean, scale, w, 0.0)

    def utilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.utilities(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)))], names=["u"])

    return Ranker(mean, scale, w, middle(rows.select("x").mapInArrow(utilities, "u double"), n[0] - 1))


def _vector():
    @F.pandas_udf("array<double>")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([features(t if isinstance(t, str) else None) for t in text])

    return vector


def scorer(model: Ranker | None):
    """A column function from features to score; 0.5 for all without a model."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if model is None or not len(x):
            return pd.Series(np.full(len(x), 0.5))
        return pd.Series(model.scores(np.stack(x.to_numpy())))

    return score


def quality_query(docs: DataFrame, labels: DataFrame, plan: RankPlan = RankPlan()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their features, all zero. Labels other than 0 and 1 and labels without document teach
    nothing; a document labelled both ways counts on both sides. Without labels of both kinds every score is 0.5. Rows
    without doc_id are not held out. Equal texts get equal scores; an empty table gives an empty result.
    """
    held = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(3)) == 1, F.lit(False))
    vectors = durable(pick(docs, doc_id="doc_id", text="text").select("doc_id", _vector()("text").alias("x")))  # read for learning and for scores
    model = train(vectors, labels, ~held(F.col("doc_id")), plan)
    d = vectors.select("doc_id", held(F.col("doc_id")).alias("held_out"), scorer(model)("x").alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
