"""Language identification with a bidirectional gated recurrent network over UTF-8 bytes.

The network reads fixed windows of bytes, A-Z as a-z. Every position gets a label distribution from the forward and
the backward state; a document's distribution is the mean over all positions of its whole text. Training is
plain numpy: backpropagation through time over the window, Adam steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import bound_batches, durable, pick

UND = "und"


@dataclass(frozen=True)
class TrainingPlan:
    """per_lang documents of each language, `windows` windows of `window` bytes from each, bound the training set."""

    per_lang: int = 400
    windows: int = 4
    window: int = 64
    hidden: int = 8
    steps: int = 260
    batch: int = 160
    rate: float = 0.03
    seed: int = 7


def has_letter(text: str) -> bool:
    """Whether a character is of one of Unicode's letter categories, as in the pattern for a letter; marks, digits and fractions aren't."""
    return any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    return np.add(x, 0.5, out=x)


class ByteBiGRU:
    """labels: class names. Parameters per direction: W (256, 3H) input rows (update, reset, candidate), U (H, 2H), V (H, H)."""

    def __init__(self, labels: list[str], hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.labels, self.hidden = list(labels), hidden
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": draw(256, 3 * hidden, scale=0.3), f"U{d}": draw(hidden, 2 * hidden, scale=0.3), f"V{d}": draw(hidden, hidden, scale=0.3)}
        self.p |= {"O": draw(2 * hidden, len(labels), scale=0.3), "c": np.zeros(len(labels), np.float32)}

    def _scan(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction for x (T, B) bytes, in the order of positions."""
        W, U, V, h_n = self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"V{d}"], self.hidden
        steps, rows = x.shape
        states = np.empty((steps, rows, h_n), np.float32)
        h, tape = np.zeros((rows, h_n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = W[x[t]]
            zr = _sigmoid(g[:, : 2 * h_n] + h @ U)
            z, r = zr[:, :h_n], zr[:, h_n:]
            n = np.tanh(g[:, 2 * h_n :] + (r * h) @ V)
            new = n + z * (h - n)
            if keep:
                tape.append((t, h, z, r, n))
            h = states[t] = new
        return states, tape

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        s = states @ self.p["O"] + self.p["c"]
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(-1, keepdims=True)
        return s

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label distribution of every position: x (T, B) bytes to (T, B, labels)."""
        return self._probabilities(np.concatenate([self._scan(x, "f", False)[0], self._scan(x, "b", False)[0]], -1))

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the positions in mask (T, B) for window labels y (B,), and its gradients."""
        h_n, (steps, rows) = self.hidden, x.shape
        both = [self._scan(x, d, True) for d in "fb"]
        states = np.concatenate([s for s, _ in both], -1)
        q = self._probabilities(states)
        weight = (mask / mask.sum())[..., None].astype(np.float32)
        loss = float(-(np.log(q[:, np.arange(rows), y] + 1e-9) * weight[..., 0]).sum())
        q[:, np.arange(rows), y] -= 1
        q *= weight
        grad = {"O": np.tensordot(states, q, ([0, 1], [0, 1])), "c": q.sum((0, 1))}
        back = q @ self.p["O"].T
        for k, d in enumerate("fb"):
            U, V = self.p[f"U{d}"], self.p[f"V{d}"]
            gW, gU, gV = np.zeros_like(self.p[f"W{d}"]), np.zeros_like(U), np.zeros_like(V)
            dh = np.zeros((rows, h_n), np.float32)
            for t, h, z, r, n in reversed(both[k][1]):
                dh = dh + back[t, :, k * h_n : (k + 1) * h_n]
                da = dh * (1 - z) * (1 - n * n)
                drh = da @ V.T
                dzr = np.concatenate([dh * (h - n) * z * (1 - z), drh * h * r * (1 - r)], 1)
                gV += (r * h).T @ da
                gU += h.T @ dzr
                np.add.at(gW, x[t], np.concatenate([dzr, da], 1))
                dh = dh * z + drh * r + dzr @ U.T
            grad |= {f"W{d}": gW, f"U{d}": gU, f"V{d}": gV}
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, plan: TrainingPlan) -> list[float]:
        """Adam over random batches of windows x (N, T) with labels y (N,). Returns the losses."""
        rng = np.random.default_rng(plan.seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses = []
        for step in range(1, plan.steps + 1):
            at = rng.integers(0, len(x), min(plan.batch, len(x)))
            loss, grad = self.gradients(x[at].T, y[at], mask[at].T)
            losses.append(loss)
            rate = plan.rate * min(1, 2 * (1 - step / (plan.steps + 1)))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def documents(self, raw: list[bytes], window: int, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Mean distribution (documents, labels) and counts of position labels, over all bytes of each text."""
        rows = min(rows, max(1, 65_536 // len(self.labels)))  # many labels, fewer rows at once
        size = np.array([len(b) for b in raw], np.int64)
        chunks = -(-size // window)
        owner = np.repeat(np.arange(len(raw)), chunks)
        left = np.full(len(owner), window, np.int64)
        ends = np.cumsum(chunks)
        left[ends[chunks > 0] - 1] = (size - (chunks - 1) * window)[chunks > 0]
        flat = np.zeros(len(owner) * window, np.uint8)
        for b, stop, n in zip(raw, ends, chunks, strict=True):
            if n:
                flat[(stop - n) * window : (stop - n) * window + len(b)] = np.frombuffer(b, np.uint8)
        x = flat.reshape(-1, window)
        pooled, votes = np.zeros((len(raw), len(self.labels))), np.zeros((len(raw), len(self.labels)), np.int64)
        full = left == window
        for some in (np.flatnonzero(full), np.flatnonzero(~full)):
            for i in range(0, len(some), rows):
                at = some[i : i + rows]
                q = self.positions(np.ascontiguousarray(x[at].T))
                best = np.eye(len(self.labels), dtype=np.float32)[q.argmax(-1)]
                if not full[at[0]]:
                    live = (np.arange(window)[:, None] < left[at])[..., None]
                    q, best = q * live, best * live
                np.add.at(pooled, owner[at], q.sum(0))
                np.add.at(votes, owner[at], best.sum(0).astype(np.int64))
        return pooled / np.maximum(size, 1)[:, None], votes


def training_windows(docs: DataFrame, plan: TrainingPlan) -> list[tuple[str, bytes]]:
    """A sample bounded in each language, not in their number: for each language the per_lang documents of lowest hash, cut at hashed places of the text."""
    d = docs.where("lang is not null and text is not null and length(text) > 0 and text rlike '\\\\p{L}'")
    h = F.xxhash64("text", F.col("doc_id"))
    cuts = F.array(*(F.substring("text", (F.pmod(F.xxhash64(F.lit(k), "h"), F.greatest(F.lit(1), F.length("text") - plan.window)) + 1).cast("int"), plan.window) for k in range(plan.windows)))
    # so few rows of a language reach its ranking, several times per_lang of them, that no task ranks a whole language;
    # a row a language, and the model holds a few hundred times as much of each
    n = F.broadcast(durable(d.groupBy("lang").agg(F.count("*").alias("n"))))
    low = F.shiftrightunsigned("h", 11) <= F.least(F.lit(1.0), 4.0 * plan.per_lang / F.col("n")) * float(2**53)
    some = d.withColumn("h", h).join(n, "lang").where((F.col("n") <= 8 * plan.per_lang) | low)
    ranked = some.select("lang", "h", cuts.alias("cuts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h"))
    ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= plan.per_lang)
    rows = ranked.select("lang", "h", "cuts").collect()
    return [(r["lang"], c.encode().lower()[: plan.window]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"])) for c in r["cuts"] if has_letter(c)]


def train(docs: DataFrame, learn: Column, plan: TrainingPlan = TrainingPlan()) -> ByteBiGRU | None:
    """Fit on the rows of (doc_id, text, lang) where `learn` holds; None if there is nothing to learn from."""
    rows = training_windows(docs.where(learn), plan)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    model = ByteBiGRU(labels, plan.hidden, plan.seed)
    x = np.zeros((len(rows), plan.window), np.uint8)
    mask = np.zeros((len(rows), plan.window), np.float32)
    for i, (_, b) in enumerate(rows):
        x[i, : len(b)], mask[i, : len(b)] = np.frombuffer(b, np.uint8), 1
    model.fit(x, np.array([labels.index(lang) for lang, _ in rows]), mask, plan)
    return model


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("position_share", T.DoubleType())])


def predictor(model: ByteBiGRU | None, window: int):
    """An Arrow-batched column function from text to (lang_pred, score, position_share)."""

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for i in range(0, len(texts), 256):
                raw = [t if isinstance(t, str) and has_letter(t) else "" for t in texts.iloc[i : i + 256]]
                if model is None:
                    out += [(UND, 0.0, 0.0)] * len(raw)
                    continue
                raw = [t.encode("utf-8", "surrogatepass").lower() for t in raw]
                pooled, votes = model.documents(raw, window)
                best = pooled.argmax(1)
                out += [(model.labels[k], min(1.0, float(p[k])), float(v[k] / len(b))) if b else (UND, 0.0, 0.0) for k, p, v, b in zip(best, pooled, votes, raw, strict=True)]
            yield pd.DataFrame(out, columns=PREDICTION.names)

    return predict


def identify(docs: DataFrame, model: ByteBiGRU | None, plan: TrainingPlan = TrainingPlan(), text: str = "text") -> DataFrame:
    """Every input column plus a struct `lid` of lang_pred, score and position_share (share of positions labelled so).

    Null or letterless text gives ('und', 0, 0); so does every text if there was nothing to learn from. Equal texts
    get equal results; an empty table gives an empty result. An input column named lid is replaced.
    """
    return docs.withColumn("lid", predictor(model, plan.window)(docs[text]))


def reject_unknown(docs: DataFrame, model: ByteBiGRU | None, min_score: float, plan: TrainingPlan = TrainingPlan()) -> DataFrame:
    """The rows of docs, with their own columns, whose language is recognised with at least min_score."""
    bound_batches(docs.sparkSession)
    kept = docs.columns
    mark = predictor(model, plan.window)(docs["text"])
    name = "lid_" + "_".join(kept)
    return docs.withColumn(name, mark).where((F.col(f"`{name}`.lang_pred") != UND) & (F.col(f"`{name}`.score") >= min_score)).select(*(docs[c] for c in kept))


def language_query(docs: DataFrame, plan: TrainingPlan = TrainingPlan()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, position_share (share of positions labelled lang_pred).

    Null texts and texts without letters are und with score 0, and every text is where no row has a language to learn. Rows
    without doc_id are not held out. Equal texts get equal results; a text of any length is read whole, and other columns of
    docs are not looked at. An empty table gives an empty result.
    """
    d = pick(docs, doc_id="doc_id", text="text", lang="lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = train(d, ~held, plan)
    return identify(d.select("doc_id", "text"), model, plan).select("doc_id", held.alias("held_out"), "lid.*")
