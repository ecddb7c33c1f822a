"""Conversation repair against a search through all edits, with conversations divided over parts, and rows of every awkward kind."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from quillspan.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def prefix(told):
    """Whether told may begin a right sequence of initials."""
    return any(GOOD.match(told + rest) for rest in ("", "a", "ua"))


def searched(rows):
    """The contract's row, by a search in the order of (cost, audit) over what is told so far."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done, best = [(0, "", 0, "", ())], set(), None
    while heap:
        cost, audit, at, told, kept = heapq.heappop(heap)
        if at == len(rows) and GOOD.match(told):
            best = cost, audit, kept
            break
        if (at, told[-1:], bool(told), told == "s") in done:
            continue
        done.add((at, told[-1:], bool(told), told == "s"))
        moves = [(2, "I", at, r, (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            moves.append((3, "D", at + 1, "", None))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                moves.append((more, "K", at + 1, role[:1] or "-", (role, text)))
                moves += [(2 + more, "R", at + 1, r, (r, text)) for r in ("user", "assistant")]
        for w, letter, then, r, turn in moves:
            now = told + r[:1]
            if prefix(now):
                heapq.heappush(heap, (cost + w, audit + letter, then, now, kept + ((turn,) if turn else ())))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    cost, audit, kept = best
    told = "\n".join(f"{a}:{b}" for a, b in kept)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(told.encode()).hexdigest(),
    )


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    return {c: searched(damage(rs)) for c, rs in convs.items()}


def found(spark, rows, plan=repair.RepairPlan(), extra=False):
    df = spark.createDataFrame([(*r, "x", 1) if extra else r for r in rows], SCHEMA + (", code string, part long" if extra else ""))
    got = [tuple(r) for r in repair.repair_query(df, plan).collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def conversation(rng, conv, n, base=0):
    texts = ["Yes.", "No?", "so it goes", "", " \t", "Well!  ", "a. ", " ", "Fine.\n"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "agent", "sys"]
    rows = []
    for k in range(n):
        turn = None if rng.random() < 0.03 else base + k + (rng.random() < 0.1) * rng.randint(0, 3)
        role = ("user", "assistant")[k % 2] if rng.random() < 0.7 else rng.choice(roles)
        text = f"text {conv} {k}." if rng.random() < 0.6 else rng.choice([*texts, None])
        rows.append((conv, turn, role, text))
    return rows


@pytest.mark.parametrize("part_rows", [50_000, 7])
def test_search(spark, part_rows):
    rng = random.Random(part_rows)
    rows = [r for c in range(60) for r in conversation(rng, c, rng.randint(1, 9))]
    rows += conversation(rng, 1000, 90) + conversation(rng, None, 25) + [(2000, 3, "user", "same."), (2000, 3, "user", "same."), (2000, 4, "user", "same.")]
    rows += [(3000, k, "user", "copied.") for k in range(40)]
    rng.shuffle(rows)
    got = found(spark, rows, repair.RepairPlan(part_rows=part_rows), extra=True)
    assert got == expected(rows)


def test_dropped_and_empty(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(gone, 0, "user", "Hello.")]) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert repair.repair_query(spark.createDataFrame([], SCHEMA)).collect() == []
    assert repair.repaired_turns(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 7)
    assert found(spark, [(kept, 0, "user", " ")])[kept] == (0, 1, 0, 0, 0, 3, "D", nothing)
    long = "words of a very long turn " * 50_000 + "."
    assert found(spark, [(kept, 0, "user", long)])[kept][-3:] == (2, "KI", hashlib.sha256(f"user:{long}\nassistant:".encode()).hexdigest())


def test_repaired_turns(spark):
    """The operator's own output: no damage, turns as rows, equal for any size of parts."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "Anyone?"), (1, 3, "assistant", "Yes."), (1, 4, "assistant", ""), (2, 0, "bot", "Cut off"), (None, 5, "user", "Hi."), (None, None, "user", "First.")]
    rows += [(9, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(60) if k != 31]
    df = spark.createDataFrame(rows, SCHEMA)
    for plan in (repair.RepairPlan(), repair.RepairPlan(part_rows=5)):
        got = {}
        for r in repair.repaired_turns(df, plan).orderBy("conv_id", "place").collect():
            got.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
        assert got[1] == [("K", "system", "Be kind."), ("K", "user", "Hello."), ("I", "assistant", ""), ("K", "user", "Anyone?"), ("K", "assistant", "Yes.")]
        assert 2 not in got and got[None] == [("K", "user", "First."), ("R", "assistant", "Hi.")]
        assert [x[1] for x in got[9]] == ["user", "assistant"] * 30 and [x[0] for x in got[9]].count("I") == 1


def test_automaton_is_searched_both_ways():
    """Costs from the front and to the end agree on every cheapest path: what a matrix of some rows tells equals the walk over them."""
    rng, plan = random.Random(3), repair.RepairPlan()
    for _ in range(300):
        codes = [rng.choice([repair.DROPPED, *range(16)]) for _ in range(rng.randint(0, 12))]
        after = repair.end_costs(plan)
        costs = repair.backward(codes, after, plan)
        m = repair.matrix(codes, plan)
        assert costs[0] == tuple(min(m[4 * q + r] + after[r] for r in repair.STATES) for q in repair.STATES)
