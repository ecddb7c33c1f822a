"""Null and repeated ids, repeated rows, very long texts and columns whose names clash, through the operators' queries."""

from __future__ import annotations

import random

import pytest

from quillspan.llm import decontam, mixing, pii, quality, simhash, sketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, row string, fp string, w long, bucket string, score string, kind string, n long"
CLASH = ("x", "x", "x", 1, "x", "x", "x", 1)
LONG = "some words of a text that is very long, " * 20_000
MAIL = "write to boss@corp.example today"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "some words in a short text"), (2, None), (3, ""), (4, LONG + MAIL), (5, MAIL), (5, MAIL), (None, MAIL), (6, LONG + MAIL)]
    return spark.createDataFrame([(i, t, None, None if i == 2 else "a", len(t or ""), *CLASH) for i, t in texts], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_pii(spark, docs):
    got = by_id(pii.privacy_query(docs))
    assert {i: [r.n_email for r in rs] for i, rs in got.items()} == {1: [0], 2: [0], 3: [0], 4: [1], 5: [1, 1], None: [1], 6: [1]}
    at = len(LONG) + MAIL.index("boss")
    assert f"email:{at}:{at + len('boss@corp.example')}" in got[4][0].spans and got[5][0] == got[5][1] and got[2][0].spans == ""
    assert pii.privacy_query(docs.limit(0)).collect() == []


def test_fingerprints(spark, docs):
    got = by_id(sketch.fingerprint_query(docs))
    assert {i: len(rs) for i, rs in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 1, 6: 1}
    assert got[4][0].fingerprint == got[6][0].fingerprint != got[1][0].fingerprint and got[2][0].fingerprint == got[3][0].fingerprint
    assert got[4][0].n_chars == len(LONG + MAIL) and got[2][0].n_chars == 0
    assert all(0 <= x <= 1 for rs in got.values() for r in rs for x in (r.near_edited, r.near_next))
    assert sketch.fingerprint_query(docs.limit(0)).collect() == []


def test_simhash(spark, docs):
    got = by_id(simhash.simhash_query(docs))
    assert got[2][0].fingerprint == got[3][0].fingerprint == "0" * 16 and got[2][0].component_id == got[3][0].component_id == 2
    assert got[4][0].fingerprint == got[6][0].fingerprint and got[6][0].component_id == 4
    assert [r.component_id for r in got[5]] == [5, 5] and [r.component_id for r in got[None]] == [5]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {1, 2, 4, 5} <= {r.doc_id for r in kept.collect()} and not {3, 6} & {r.doc_id for r in kept.collect()}


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, "x", "x") for i in [*range(1, 7), 5]], "doc_id long, quality int, text string, score string")
    got = by_id(quality.quality_query(docs, labels))
    assert {i: len(rs) for i, rs in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 1, 6: 1}
    assert got[4][0].score == got[6][0].score and got[5][0] == got[5][1] and got[2][0].score == got[3][0].score
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for rs in got.values() for r in rs)


def test_decontamination(spark, docs):
    rng = random.Random(5)
    item = " ".join(f"{rng.choice('abcdefgh')}{k}x" for k in range(20))
    bench = spark.createDataFrame([(7, item, "x", 1), (7, item, "x", 1), (None, item, "x", 1), (8, None, "x", 1)], "item_id long, text string, doc_id string, w long")
    more = spark.createDataFrame([(9, f"{LONG}{item} {LONG}", None, "a", 1, *CLASH)] * 2 + [(None, item, None, "a", 1, *CLASH)], SCHEMA)
    got = decontam.leaks(docs.union(more), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(9, 7)]
    left = decontam.decontaminate(docs.union(more), bench)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect() if r.doc_id) == [1, 2, 3, 4, 5, 5, 6]


def test_mixing(spark, docs):
    got = mixing.mixed(docs).collect()
    assert mixing.mixed(docs).columns == [*docs.columns, "mix_epoch", "mix_slot", "mix_position"]
    assert sorted((r.doc_id or 0) for r in got if r.mix_epoch == 0) == [0, 1, 2, 3, 4, 5, 5, 6] and len({r.mix_position for r in got}) == len(got)
    assert {r.row for r in got} == {"x"} and mixing.mixed(docs.limit(0)).collect() == []
