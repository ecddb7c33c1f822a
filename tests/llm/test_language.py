"""Pooling and gradients against plain loops, letters, and awkward rows."""

import numpy as np
import pytest

from quillspan.llm import language


def scan(p, d, x):
    h, out = np.zeros(len(p[f"U{d}"])), []
    n = len(h)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for c in x if d == "f" else x[::-1]:
        g = p[f"W{d}"][c].astype(float)
        zr = sigmoid(g[: 2 * n] + h @ p[f"U{d}"])
        z, r = zr[:n], zr[n:]
        h = z * h + (1 - z) * np.tanh(g[2 * n :] + (r * h) @ p[f"V{d}"])
        out.append(h)
    return out if d == "f" else out[::-1]


def plain_positions(model, x):
    rows = []
    for f, b in zip(scan(model.p, "f", x), scan(model.p, "b", x), strict=True):
        s = np.concatenate([f, b]) @ model.p["O"] + model.p["c"]
        e = np.exp(s - s.max())
        rows.append(e / e.sum())
    return np.array(rows)


def test_pooling_brute_force():
    model = language.ByteBiGRU(["a", "b", "c"], 4, 3)
    raw = [b"", b"x", b"hello there", bytes(range(97, 123)) * 3, b"0123456789"]
    pooled, votes = model.documents(raw, 10)
    for k, text in enumerate(raw):
        parts = [np.frombuffer(text[i : i + 10], np.uint8) for i in range(0, len(text), 10)]
        # a last window is filled with zero bytes, which the backward states read and no position counts
        q = [plain_positions(model, np.concatenate([x, np.zeros(10 - len(x), np.uint8)]))[: len(x)] for x in parts]
        q = np.concatenate(q) if q else np.zeros((0, 3))
        assert pooled[k] == pytest.approx(q.mean(0) if len(q) else np.zeros(3), abs=1e-4)
        assert votes[k].tolist() == np.bincount(q.argmax(1), minlength=3).tolist()


def test_every_gradient():
    model = language.ByteBiGRU(["a", "b"], 2, 5)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x, y, mask = rng.integers(0, 3, (5, 3)), np.array([0, 1, 1]), np.ones((5, 3))
    mask[3:, 1] = 0
    _, grad = model.gradients(x, y, mask)
    for name, w in model.p.items():
        for at in np.ndindex(w[:3].shape):
            was = w[at]
            w[at] = was + 1e-3
            up = model.gradients(x, y, mask)[0]
            w[at] = was - 1e-3
            down = model.gradients(x, y, mask)[0]
            w[at] = was
            assert grad[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_letters_and_rows(spark):
    assert [language.has_letter(t) for t in ("²½", "Ⅷ 12", "a", "é", "ß", "字", "ª", "_", "")] == [False, False, True, True, True, True, True, False, False]
    long = "the house and the garden " * 40_000
    docs = spark.createDataFrame([(4 * k, t, lang, "s", 1) for k in range(40) for t, lang in (("the house and the garden", "en"), ("das haus und der garten", "de"))], "doc_id long, text string, lang string, lid string, score long")
    odd = spark.createDataFrame([(1, "²½", None, "x", 1), (None, None, None, "x", 1), (2, long, None, "x", 1), (2, long, None, "x", 1), (3, "das haus", "en", "x", 1)], docs.schema)
    got = [r for r in language.language_query(docs.union(odd), language.TrainingPlan(steps=60, per_lang=30)).collect() if r.doc_id in (None, 1, 2)]
    assert sorted(r.lang_pred for r in got) == ["en", "en", "und", "und"] and len({(r.lang_pred, r.score) for r in got if r.doc_id == 2}) == 1


def test_the_sample_is_the_lowest_hashes(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 50 = 0, 'rare', 'common') as lang")
    got = language.training_windows(docs, language.TrainingPlan(per_lang=20, windows=1))
    assert [lang for lang, _ in got] == ["common"] * 20 + ["rare"] * 20
    rows = docs.selectExpr("lang", "text", "xxhash64(text, doc_id) as h").collect()
    for lang in ("common", "rare"):
        low = sorted((r.h % 2**64 >> 11, r.h, r.text) for r in rows if r.lang == lang)[:20]
        assert sorted(t for x, t in got if x == lang) == sorted(t.encode() for _, _, t in low)
