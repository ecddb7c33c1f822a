"""Conversations of many parts are decoded along one path."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, enter int, x long"


def total(hmm, lines, path):
    e = chat.emissions(hmm, lines)
    return hmm.start[path[0]] + sum(hmm.move[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[k, s] for k, s in enumerate(path))


def some_lines(rng, n):
    return [rng.choice(["User: ", "AI: ", "", "", "Q: ", "Someone: "]) + rng.choice(["well?", "so it is", "x" * 50, "y" * 130 + "?"]) for _ in range(n)]


@pytest.mark.parametrize("cut", [1, 2, 5, 40])
def test_parts_by_hand(cut):
    rng, hmm = random.Random(cut), chat.fit([])
    lines = some_lines(rng, 40)
    parts = [lines[i : i + cut] for i in range(0, 40, cut)]
    steps = [chat.transfer(hmm, p) for p in parts]
    whole = chat.viterbi(hmm, lines)
    assert chat.composed(steps)[6].max() == total(hmm, lines, whole)
    path = [s for p, a, b in zip(parts, *chat.between(steps), strict=True) for s in chat.viterbi(hmm, p, a, b)]
    assert total(hmm, lines, path) == total(hmm, lines, whole)


@pytest.mark.parametrize("bits", [1, 10])
def test_parts_on_spark(spark, bits):
    rng = random.Random(3)
    texts = {c: some_lines(rng, n) for c, n in ((1, 23), (2, 2), (None, 9))}
    rows = [(c, 5 * t - 20, "user", text, "p", 7, t) for c, ts in texts.items() for t, text in enumerate(ts) if not (c == 1 and 0 <= 5 * t - 30 < 10)]
    rows += [(4, None, None, None, None, None, None)] * 2
    plan, hmm = chat.ChatPlan(turns_per_part=10, group_bits=bits), chat.fit([])
    raw = chat.raw_transcripts(spark.createDataFrame(rows, SCHEMA), plan).select("conv_id", "part", "gold_roles", "transcript")
    raw = raw.union(spark.createDataFrame([(1, 1, "", " \n "), (1, 50, "", None)], "conv_id long, part long, gold_roles string, transcript string")).cache()
    got = {(r.conv_id, r.part): r for r in chat.parse_transcripts(raw, hmm, plan).collect()}
    assert len(got) == raw.count() and got[4, 0].rendered == "<|user|>\n\n<|end|>"
    assert got[1, 50].rendered == got[1, 50].roles == "" and got[1, 50].n_lines == got[1, 1].n_lines == 0
    by_part = {c: {r.part: chat._lines(r.transcript) for r in raw.where(F.col("conv_id").eqNullSafe(F.lit(c))).orderBy("part").collect()} for c in texts}
    for c, parts in by_part.items():
        parts = {p: x for p, x in parts.items() if x}
        enters, lasts = chat.between([chat.transfer(hmm, x) for x in parts.values()])
        for (p, x), a, b in zip(parts.items(), enters, lasts, strict=True):
            turns = chat.parse(hmm, "\n".join(x), a, b)
            assert got[c, p].rendered == chat.render(turns) and got[c, p].n_lines == len(x)


def test_marker_after_long_white_space():
    line = " " * 100_300 + "Human: hi"
    assert chat.split_marker(line) == ("user", "hi") and chat.split_marker("w" * 200_000) == ("none", "w" * 200_000)


def test_empty_table(spark):
    assert chat.chat_query(spark.createDataFrame([], SCHEMA)).collect() == []
