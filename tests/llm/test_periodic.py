"""Runs against a search through all periods; the query's damage and digests; texts of every awkward kind."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillspan.llm import periodic


def searched(words, repeats=4, least=6):
    """(start, end, period) of the maximal runs, by comparing words at every distance."""
    n, out = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def sample(rng):
    n, k = rng.randint(0, 60), rng.randint(1, 3)
    w = [rng.randrange(k) for _ in range(n)]
    if n > 8 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w + [9] * rng.randint(0, 3) + w if rng.random() < 0.4 else w


@pytest.mark.parametrize("repeats,least", [(2, 2), (3, 6), (4, 6)])
def test_runs(repeats, least):
    """Documents side by side, on small alphabets, with periodic tails and with texts told twice, so that blocks hold copied runs."""
    rng = random.Random(repeats)
    for _ in range(800):
        docs = [sample(rng) for _ in range(rng.randint(0, 5))]
        got = periodic.find_runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs], np.int64), periodic.RunPlan(repeats, least))
        want, at = [], 0
        for d in docs:
            want += [(s + at, e + at, q) for s, e, q in searched(d, repeats, least)]
            at += len(d)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_levels():
    """Names are equal exactly where stretches are; longest previous factors are those of a search."""
    rng = random.Random(8)
    for _ in range(200):
        w = sample(rng)
        n = len(w)
        if not n:
            continue
        levels = periodic.rank_levels(np.array(w, np.int64), np.full(n, n))
        for k, level in enumerate(levels):
            for i in range(n):
                for j in range(i):
                    assert (level[i] == level[j]) == (i + 2**k <= n and w[i : i + 2**k] == w[j : j + 2**k])
        factor, source = periodic.previous_factors(levels)
        for i in range(n):
            most = max((next((x for x in range(n - i) if w[i + x] != w[j + x]), n - i) for j in range(i)), default=0)
            assert factor[i] == most and (not most or (source[i] < i and w[source[i] : source[i] + most] == w[i : i + most]))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = [(s, e - s, q) for s, e, q in searched(words)]
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark):
    rng = random.Random(4)
    words = ["a", "b", "été x", " ", "c\x1cd"]
    docs = [(k, " ".join(rng.choice(words[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 80)))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r "), (203, "x"), (None, "a b " * 9), (None, None), (204, "a\tb\r\nc " * 7), (204, "a\tb\r\nc " * 7)]
    docs += [(205, "one two three " * 3000), (206, "z " * 5000 + "end")]
    df = spark.createDataFrame([(*d, "x", 1, "x") for d in docs], "doc_id long, text string, seed string, n_runs long, start string")
    got = [tuple(r) for r in periodic.runs_query(df, periodic.RunPlan(words=300)).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(*d)) for d in docs)
    assert sum(zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in docs) > 10 and sum(r[1] > 0 for r in got) > 30
    assert periodic.runs_query(df.limit(0)).collect() == [] and periodic.document_runs(df.limit(0)).collect() == []
    runs = sorted(tuple(r) for r in periodic.document_runs(df).where("doc_id >= 204").collect())
    assert runs == [(204, 0, 21, 3), (204, 0, 21, 3), (205, 0, 9000, 3), (206, 0, 5000, 1)]


def test_collapse(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, "go on on on on on on now"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in periodic.collapse_runs(df).collect()} == {1: "a  b", 2: "go on now", 3: None, 4: ""}


def test_whole_texts(spark):
    """The small table's texts, damaged ones among them; the longest are left to the search on small alphabets."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if len(r.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in periodic.runs_query(df).collect()}
    assert len(got) == df.count() and len(short) > 100
    for d in short:
        assert got[d[0]] == expected(*d)
