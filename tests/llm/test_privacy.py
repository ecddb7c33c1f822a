"""Disclosure by co-occurrence against brute force."""

import hashlib
import random
import re
from math import log2

import pytest

from quillspan.llm import pii


def classes(kind, value):
    if kind == "email":
        return {(kind, value.lower()), (kind, value.lower().split("@")[1])}
    if kind == "ip":
        a, b, c, _ = value.split(".")
        return {(kind, value), (kind, a, b, c), (kind, a, b)}
    digits = re.sub("[^0-9]", "", value)
    return {(kind, digits), (kind, "first", digits[: 6 if kind == "card" else 4])}


def brute_disclosure(texts, plan):
    """(term: the most of an entity's bits that it discloses, of those that reach the threshold; term: the letters that it keeps)."""
    told = []
    for t in texts:
        spans = pii.base_spans(t)
        held = {e for k, a, b in spans for e in classes(k, t[a:b]) | {(k,)}}
        words = lambda x: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", x)}
        outside = {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t or "") if not any(m.start() < b and a < m.end() for _, a, b in spans)}
        told.append((held, outside, words(t or "")))
    n, out, least = len(texts), {}, {}
    for e in {e for held, _, _ in told for e in held}:
        n_e = sum(e in held for held, _, _ in told)
        for t in {t for held, outside, _ in told if e in held for t in outside}:
            c = sum(e in held and t in outside for held, outside, _ in told)
            n_t = sum(t in every for _, _, every in told)
            if n_e >= plan.support and c >= plan.support and n_e < n:
                share = log2(n * c / (n_e * n_t)) / log2(n / n_e)
                if share >= plan.generalise:
                    out[t] = max(out.get(t, 0), share)
                    least[t] = min(least.get(t, n), log2(n / n_e))
    counts = {}
    for _, _, every in told:
        for t in every:
            counts[t] = counts.get(t, 0) + 1
    keep = {}
    for t, share in out.items():
        safe = [k for k in range(1, min(plan.stem, len(t) - 1) + 1) if log2(n / max(c for x, c in counts.items() if x.startswith(t[:k]))) < plan.generalise * least[t]]
        keep[t] = max(safe, default=0) if share < plan.remove else 0
    return out, keep


@pytest.mark.parametrize("bound", [100_000, 2])
def test_disclosure_brute_force(spark, bound):
    rng = random.Random(bound)
    plan = pii.PrivacyPlan(broadcast_rows=bound)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(40)]
    near = {"ann@north.example": "falcon", "bob@north.example": "falcon", "10.0.0.1": "router", "10.0.0.2": "router", "+49 30 1234567": "berlin", "4111 1111 1111 1111": "visitor"}
    texts = [None, ""]
    for _ in range(150):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.3:
            value = rng.choice(list(near))
            t.insert(rng.randrange(len(t)), value)
            if rng.random() < 0.9:
                t.append(near[value])
        texts.append(" ".join(t))
    docs = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_terms long, term long, privacy string")
    found = pii.revealing_terms(docs.select("doc_id", "text"), plan).collect()
    got = {r.term: r.disclosure for r in found}
    want, keep = brute_disclosure(texts, plan)
    assert {r.term: r.keep for r in found} == keep and set(got) == set(want) and {"falcon", "router", "berlin", "visitor"} <= set(want)
    assert all(got[t] == pytest.approx(want[t]) for t in want)
    rows = {r.doc_id: r for r in pii.privacy_query(docs, plan).collect()}
    for k, t in enumerate(texts):
        base, terms, clean = pii.sanitise_text(t, keep)
        assert rows[k].n_terms == len(terms) and rows[k].sanitised_sha256 == hashlib.sha256((clean or "").encode()).hexdigest()
        assert not any(w in (clean or "") for w in ("falcon", "router", "example"))


def test_rows(spark):
    long = "boss@corp.example " + "word " * 300_000 + "10.0.0.1"
    docs = spark.createDataFrame([(1, "a@b.cd x")] * 3 + [(2, long), (None, "a@b.cd y")], "doc_id long, text string")
    got = pii.privacy_query(docs).collect()
    assert [r.n_email for r in got] == [1] * 5 and len({r for r in got if r.doc_id == 1}) == 1
    assert next(r for r in got if r.doc_id == 2).n_ip == 1


def test_generalised(spark):
    """A term that reveals keeps a beginning that common words share; one whose beginnings are all rare goes."""
    rng = random.Random(2)
    common = ["falter", "falling", "water"]
    texts = [" ".join(rng.choice(common) for _ in range(8)) for _ in range(300)]
    for k in range(0, 60, 6):
        texts[k] += " falcon xylograph write to boss@corp.example"
    for k in range(3, 6):
        texts[k] += " falcon xylograph"
    plan = pii.PrivacyPlan(remove=0.999)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keep = {r.term: r.keep for r in pii.revealing_terms(docs, plan).collect()}
    assert keep["falcon"] == 3 and keep["xylograph"] == 0
    got = {r.doc_id: r.privacy.sanitised for r in pii.sanitise(docs, plan).collect()}
    assert " fal*  " in got[0] and "[EMAIL]" in got[0] and not any("falcon" in t or "xylo" in t for t in got.values())
