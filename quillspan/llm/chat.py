"""Transcript parsing with a hidden Markov model, and canonical chat rendering.

A transcript's lines are observed as speaker marker and line features (length, question, greeting-like brevity). Hidden states
are a role with begin or go on. Viterbi finds the most likely states: markers weigh most, alternation and line features
decide where markers are missing or odd. Parameters are counts with add-one smoothing from a bounded sample of transcripts
whose roles are known, on top of a prior that knows common markers.

A long conversation is several parts, and one most likely path runs through all of them: each part is summed up as the best
scores from any state before it to any state at its end. These products compose, in groups of bounded size and level over
level, so that every part learns the states that it lies between and is then decoded by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import durable, pick

ROLES = ("system", "user", "assistant")
# Names that open a speaker's turn.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "me", "prompter", "instruction"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "response", "gpt", "model"),
}
NAMES = {name: role for role, names in MARKERS.items() for name in names}
MARKER = re.compile(r"^\s*(?:<\|?(?:im_start\|>)?\s*|\[|\*\*|#+\s*)?(?P<name>[^\W\d_]{1,14}(?:\s\d{1,3})?)(?:\|?>|\]|\*\*\s*:?|\s*[:>—-](?=\s|$)|:)\s*(?P<rest>.*)$", re.S)
STATES = [(role, begin) for role in ROLES for begin in (True, False)]
SIGNS = ["system", "user", "assistant", "other", "none"]


@dataclass(frozen=True)
class ChatPlan:
    """turns_per_part: turns of one conversation in a row of the result; a longer conversation is several parts. group_bits: parts composed in one group, as a power of 2. sample: labelled conversations that the model is counted from, sample_turns turns of each at most."""

    turns_per_part: int = 512
    group_bits: int = 10
    sample: int = 400
    sample_turns: int = 64


@dataclass(frozen=True)
class Hmm:
    """Log probabilities in integer units of 2**-20: sums are exact in any order."""

    start: np.ndarray
    move: np.ndarray
    sign: np.ndarray  # (states, signs)
    shape: np.ndarray  # (states, shapes)


def split_marker(line: str) -> tuple[str, str]:
    """(sign, rest): the role that a speaker marker at the line's start names, 'other' for an unknown speaker's, 'none' without one."""
    m = MARKER.match(line)
    if m is None:
        return "none", line
    role = NAMES.get(m["name"].lower().split()[0])
    if role is None:
        return ("other", line)
    return role, line[m.start("rest") :]


def shape(line: str) -> int:
    """0 to 7: length class (under 40, 120, 400 code points, longer), and whether the line asks."""
    n = len(line)
    return 2 * ((n >= 40) + (n >= 120) + (n >= 400)) + ("?" in line)


def prior() -> tuple[np.ndarray, ...]:
    """Pseudo-counts: markers name their role, turns alternate, a system turn comes first."""
    start = np.array([4.0 if r == "system" and b else 5.0 if r == "user" and b else 1.0 if b else 0.01 for r, b in STATES])
    move = np.full((6, 6), 0.02)
    for i, (r, _) in enumerate(STATES):
        for j, (s, b) in enumerate(STATES):
            if not b:
                move[i, j] = 5.0 if r == s else 1e-6
            else:
                move[i, j] = 0.2 if r == s else 4.0 if (r, s) in (("user", "assistant"), ("assistant", "user"), ("system", "user")) else 0.1
    sign = np.full((6, 5), 0.05)
    for i, (r, b) in enumerate(STATES):
        sign[i, SIGNS.index(r)] = 20.0 if b else 0.02
        sign[i, SIGNS.index("none")] = 3.0 if b else 20.0
        sign[i, SIGNS.index("other")] = 0.5
    return start, move, sign, np.ones((6, 8))


def fit(labelled: list[list[tuple[str, list[str]]]]) -> Hmm:
    """labelled: transcripts of turns (role, lines with the marker on the first)."""
    start, move, sign, shapes = prior()
    for turns in labelled:
        last = None
        for role, lines in turns:
            for k, line in enumerate(lines):
                state = STATES.index((role if role in ROLES else "user", k == 0))
                mark, rest = split_marker(line)
                sign[state, SIGNS.index(mark)] += 1
                shapes[state, shape(rest)] += 1
                if last is None:
                    start[state] += 1
                else:
                    move[last, state] += 1
                last = state
    log = lambda x: np.rint(np.log(x / x.sum(-1, keepdims=True)) * 2**20).astype(np.int64)
    return Hmm(log(start), log(move), log(sign), log(shapes))


def emissions(hmm: Hmm, lines: list[str]) -> np.ndarray:
    seen = [split_marker(line) for line in lines]
    return np.array([hmm.sign[:, SIGNS.index(m)] + hmm.shape[:, shape(rest)] for m, rest in seen])


def viterbi(hmm: Hmm, lines: list[str], enter: int = -1, last: int | None = None) -> list[int]:
    """The most likely state of every line, after the state `enter` (-1: at the start) and with the state `last` in the end, if given; ties go to the state listed first."""
    if not lines:
        return []
    emit = emissions(hmm, lines)
    score, back = (hmm.start if enter < 0 else hmm.move[enter]) + emit[0], []
    for e in emit[1:]:
        via = score[:, None] + hmm.move
        back.append(via.argmax(0))
        score = via.max(0) + e
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def transfer(hmm: Hmm, lines: list[str]) -> np.ndarray:
    """(7, 6): the best score of lines that end in a state, after each state before them; the seventh row is for lines at the start."""
    emit = emissions(hmm, lines)
    best = np.vstack([hmm.move, hmm.start]) + emit[0]
    for e in emit[1:]:
        best = (best[:, :, None] + hmm.move).max(1) + e
    return best


def composed(steps: np.ndarray) -> np.ndarray:
    """The transfer of parts that follow each other."""
    best = steps[0]
    for step in steps[1:]:
        best = (best[:, :, None] + step[:6]).max(1)
    return best


def between(steps: np.ndarray, enter: int = -1, last: int | None = None) -> tuple[list[int], list[int]]:
    """The states before each part and at its end on the best path; ties go to the state listed first, from the end on."""
    scores = [steps[0][enter]]
    for step in steps[1:]:
        scores.append((scores[-1][:, None] + step[:6]).max(0))
    ends = [int(scores[-1].argmax()) if last is None else last]
    for score, step in zip(scores[-2::-1], steps[:0:-1], strict=True):
        ends.append(int((score + step[:6, ends[-1]]).argmax()))
    ends.reverse()
    return [enter, *ends[:-1]], ends


def parse(hmm: Hmm, transcript: str | None, enter: int = -1, last: int | None = None) -> list[tuple[str, str]]:
    """(role, text) turns of a transcript; markers that name the turn's role are taken off. Null or blank: none."""
    lines = _lines(transcript)
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, viterbi(hmm, lines, enter, last), strict=True):
        role, begins = STATES[state]
        mark, rest = split_marker(line)
        text = rest if begins and mark == role else line
        if begins or not turns or turns[-1][0] != role:
            turns.append((role, [text]))
        else:
            turns[-1][1].append(text)
    return [(role, "\n".join(x).strip()) for role, x in turns]


def _lines(transcript: str | None) -> list[str]:
    return [x for x in (transcript or "").split("\n") if x.strip()]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: each turn between <|role|> and <|end|>, one after the other."""
    return "\n".join(f"<|{role}|>\n{text}\n<|end|>" for role, text in turns)


def part_states(transcripts: DataFrame, hmm: Hmm, plan: ChatPlan) -> DataFrame | None:
    """(conv_id, part, enter, last): the states that the parts with lines of conversations of several parts lie between. None if there is no such conversation."""
    steps = "conv_id long, part long, t array<long>"
    states = "conv_id long, part long, enter int, last int"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_lines(text) for text in map(pa.StringScalar.as_py, b.column(2))]
            rows = pa.array([k for k, lines in enumerate(found) if lines], pa.int64())
            t = pa.array([transfer(hmm, lines).ravel().tolist() for lines in found if lines], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), t], names=["conv_id", "part", "t"])

    def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by("part")
        return table, np.array(table["t"].to_pylist(), np.int64).reshape(-1, 7, 6)

    def product(table: pa.Table) -> pa.Table:
        table, t = ordered(table)
        return pa.table([table["conv_id"][:1], table["up"][:1], pa.array([composed(t).ravel().tolist()], pa.list_(pa.int64()))], names=["conv_id", "part", "t"])

    def solved(table: pa.Table) -> pa.Table:
        table, t = ordered(table)
        given = (table["enter"][0].as_py(), table["last"][0].as_py()) if "enter" in table.column_names else ()
        found = [pa.array(x, pa.int32()) for x in between(t, *given)]
        return pa.table([table["conv_id"], table["part"], *found], names=["conv_id", "part", "enter", "last"])

    # a row for each conversation of several parts: turns_per_part times fewer than turns at least
    several = durable(transcripts.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c")))
    if several.isEmpty():
        return None
    some = transcripts.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    levels = [durable(some.select("conv_id", "part", "transcript").mapInArrow(summed, steps))]
    up = F.shiftright("part", plan.group_bits)
    while True:
        low, high = levels[-1].agg(F.min("part"), F.max("part")).first()
        if low is None or high - low < 2**plan.group_bits:
            break
        levels.append(durable(levels[-1].withColumn("up", up).groupBy("conv_id", "up").applyInArrow(product, steps)))
    known = levels[-1].groupBy("conv_id").applyInArrow(solved, states)
    for level in reversed(levels[:-1]):
        above = known.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "enter", "last")
        told = level.withColumn("up", up).join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("p")))
        known = told.select("conv_id", "up", "part", "t", "enter", "last").groupBy("conv_id", "up").applyInArrow(solved, states)
    return durable(known)


def parse_transcripts(transcripts: DataFrame, hmm: Hmm, plan: ChatPlan = ChatPlan()) -> DataFrame:
    """Rows of (conv_id, part, gold_roles, transcript) with n_lines, roles and rendered in place of the transcript.

    The parts of a conversation are decoded along one path; a turn that goes on over the end of a part is rendered in each of
    them. Null and blank transcripts give no turn. A line of any length is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, enter, last in zip(map(pa.StringScalar.as_py, b.column(3)), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                turns = parse(hmm, text, -1 if enter is None else enter, last)
                out.append((len(_lines(text)), ",".join(r for r, _ in turns), render(turns)))
            n, roles, shown = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(roles, pa.string()), pa.array(shown, pa.string())], names=["conv_id", "part", "gold_roles", "n_lines", "roles", "rendered"])

    t = transcripts.select("conv_id", "part", "gold_roles", "transcript")
    states = part_states(t, hmm, plan)
    if states is None:
        t = t.withColumns({"enter": F.lit(None).cast("int"), "last": F.lit(None).cast("int")})
    else:
        states = states.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "enter", "last")
        t = t.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")
    return t.mapInArrow(run, "conv_id long, part long, gold_roles string, n_lines long, roles string, rendered string")


def _part(plan: ChatPlan) -> Column:
    return F.floor(F.coalesce("turn", F.lit(0)) / plan.turns_per_part).cast("long")


def raw_transcripts(conversations: DataFrame, plan: ChatPlan) -> DataFrame:
    """(conv_id, part, gold, gold_roles, transcript): conversations written down as people would, in one of four marker styles by conv_id, with
    the marker of every fifth turn or so left out.

    Turns are ordered by turn, then role and text; repeated rows count once. A part holds turns_per_part consecutive turn numbers
    of a conversation, so a huge conversation is many rows. Null roles count as user, null texts as empty, a null turn as 0.
    """
    c = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    turn = F.coalesce("turn", F.lit(0))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    names = [{"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, {"system": "### Instructions: ", "user": "Human: ", "assistant": "AI: "}, {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "}, {"system": "Context: ", "user": "Q: ", "assistant": "A: "}]
    marker = F.lit("")
    for k, by in enumerate(names):
        for r, shown in by.items():
            marker = F.when((style == k) & (role == r), shown).otherwise(marker)
    silent = (F.pmod(F.xxhash64("conv_id", turn, F.lit(1)), F.lit(5)) == 0) & (turn > 0)
    body = F.concat(F.when(silent, "").otherwise(marker), text)
    lacking = F.array(*(F.col(x).isNull() for x in ("turn", "role", "text")))  # a null and what it counts as are two rows
    rows = c.select("conv_id", _part(plan).alias("part"), F.struct(turn.alias("turn"), role.alias("role"), body.alias("body"), lacking.alias("lacking")).alias("x"))
    told = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_set("x")).alias("xs"))
    return told.select("conv_id", "part", F.transform("xs", lambda x: F.struct(x["role"], x["body"])).alias("gold"), F.array_join(F.transform("xs", lambda x: x["role"]), ",").alias("gold_roles"), F.array_join(F.transform("xs", lambda x: x["body"]), "\n").alias("transcript"))


def chat_query(conversations: DataFrame, plan: ChatPlan = ChatPlan()) -> DataFrame:
    """A row per part of a conversation: conv_id, part, n_lines, gold_roles as written, roles as recovered, rendered chat.

    Null roles count as user, null texts as empty, a null turn as 0; rows without conv_id are one conversation. Rows of one turn are
    ordered by role, then text, and repeated rows count once; a turn without text has a marker at most. A text of any length is
    read whole, a conversation of any length in parts. An empty table gives an empty one; extra columns don't matter.
    """
    raw = raw_transcripts(conversations, plan)
    # the keys of the sample first, so that no other text is read for it
    keys = raw.select("conv_id", "part").orderBy(F.xxhash64("conv_id"), "conv_id", "part").limit(plan.sample)
    keys = F.broadcast(raw.sparkSession.createDataFrame(keys.collect(), "c long, p long"))  # plan.sample rows at most
    bare = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    few = bare.join(keys, F.col("conv_id").eqNullSafe(F.col("c")) & (_part(plan) == F.col("p")), "left_semi")
    sample = raw_transcripts(few, plan).select(F.slice("gold", 1, plan.sample_turns).alias("gold")).collect()
    hmm = fit([[(t["role"], [x for x in t["body"].split("\n") if x.strip()]) for t in r["gold"]] for r in sample])
    return parse_transcripts(raw, hmm, plan)
