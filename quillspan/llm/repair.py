"""Conversation structure repair: the cheapest edits that make a conversation's roles read (s?(ua)+)?, of those the ASCII-least.

A conversation is a graph: its nodes are a place between rows and a state (nothing told yet, after a system turn, after a user
turn, after an answer), its arcs the edits Delete, Insert, Keep and Rerole with their costs. Costs from the front and costs to the
end tell which arcs lie on a cheapest path: those that are tight. The audit follows tight arcs with the set of states that the letters
so far lead to, and takes the least letter that any of them has.

Rows are sorted over the whole table by range, so that a conversation of any size is many parts, of some `part_rows` rows each. Only a
conversation at the border of two parts is divided, so there are fewer divided ones than parts, and parts of them than twice as many.
For these, each part yields its min-plus matrix, from which the driver has the costs at every border; then, for each state on a
cheapest path, the states in which the audit leaves the part. Then every part is repaired by itself, and the pieces of divided
conversations are put together in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bound_batches, durable, pick

WHITE = r"\x20\x09-\x0D"
BEGIN, SYSTEM, USER, ANSWER = STATES = range(4)
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
CLASSES = "sua"  # initials; any other is 3
DROPPED = -1  # a row that only tells that its conversation exists
FAR = 1 << 50
INSERTED = (USER, USER, ANSWER, USER)  # what an inserted turn leads to, by state
ROLE = {USER: "user", ANSWER: "assistant"}
Costs = tuple[int, ...]


@dataclass(frozen=True)
class RepairPlan:
    """Costs of the edits, and about how many rows a part has: a task holds one part of one conversation."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1
    part_rows: int = 50_000


@lru_cache(maxsize=256)
def arcs(code: int, plan: RepairPlan) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, state, next state, cost) of a row of a class and fault, code = 4 * class + fault, in the order of letters."""
    if code == DROPPED:
        return tuple(("", q, q, 0) for q in STATES)
    kind, fault = divmod(code, 4)
    out = [("D", q, q, plan.delete) for q in STATES]
    if fault in (SOUND, TRUNCATED):
        more = plan.truncated * (fault == TRUNCATED)
        keeps = {0: [(BEGIN, SYSTEM)], 1: [(BEGIN, USER), (SYSTEM, USER), (ANSWER, USER)], 2: [(USER, ANSWER)]}.get(kind, [])
        out += [("K", q, r, more) for q, r in keeps]
        out += [("R", q, r, plan.rerole + more) for q, r in ((BEGIN, USER), (SYSTEM, USER), (USER, ANSWER), (ANSWER, USER))]
    return tuple(out)


def _with_inserts(costs: list[int], plan: RepairPlan) -> Costs:
    """Costs to the end where turns may be inserted first; more than two in a row never pay."""
    for _ in range(2):
        costs = [min(costs[q], plan.insert + costs[INSERTED[q]]) for q in STATES]
    return tuple(min(c, FAR) for c in costs)


def end_costs(plan: RepairPlan) -> Costs:
    return _with_inserts([0, FAR, FAR, 0], plan)


def step_back(code: int, after: Costs, plan: RepairPlan) -> Costs:
    """Costs to the end before a row, by state, from those behind it."""
    costs = [FAR] * 4
    for _, q, r, w in arcs(code, plan):
        costs[q] = min(costs[q], w + after[r])
    return _with_inserts(costs, plan) if code != DROPPED else tuple(costs)


def backward(codes: list[int], after: Costs, plan: RepairPlan) -> list[Costs]:
    """Costs to the end at every place: before each row and, last, behind them all."""
    out = [after]
    for code in reversed(codes):
        out.append(step_back(code, out[-1], plan))
    return out[::-1]


def matrix(codes: list[int], plan: RepairPlan) -> list[int]:
    """The min-plus matrix of some rows: entry 4 * q + r is the cost from state q before them to state r behind them."""
    columns = [backward(codes, tuple(0 if q == r else FAR for q in STATES), plan)[0] for r in STATES]
    return [columns[r][q] for q in STATES for r in STATES]


def traverse(codes: list[int], costs: list[Costs], states: frozenset[int], last: bool, plan: RepairPlan) -> tuple[list[tuple[str, int, int]], frozenset[int]]:
    """The edits (letter, row or -1, state that it leads to) of the ASCII-least audit from a set of states on cheapest paths, and
    the states in which it leaves the rows. Inserts behind the last row are part of it if `last`."""
    out, at = [], 0
    while True:
        here = costs[at]
        moves: dict[str, set[int]] = {}
        row = at < len(codes)
        if row:
            after = costs[at + 1]
            for letter, q, r, w in arcs(codes[at], plan):
                if q in states and here[q] == w + after[r]:
                    moves.setdefault(letter, set()).add(r)
        if (row and codes[at] != DROPPED) or (last and not row):
            for q in states:
                if here[q] and here[q] == plan.insert + here[INSERTED[q]]:
                    moves.setdefault("I", set()).add(INSERTED[q])
        if not moves or (not row and not last):
            return out, states
        letter = min(moves)
        states = frozenset(moves[letter])
        if letter:
            out.append((letter, -1 if letter == "I" else at, min(states)))
        at += letter != "I"


def faults(role: Column, text: Column) -> Column:
    """blank or truncated, else sound; duplicates are found over rows."""
    final = F.regexp_extract(text, rf"([^{WHITE}])[{WHITE}]*\z", 1)
    return F.when(final == "", BLANK).when(final.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)


def _sorted_rows(rows: DataFrame, plan: RepairPlan) -> DataFrame:
    """rows (conv_id, turn, role, text, live) with `code` and `part`, sorted by conversation and turn over parts; durable.

    Rows of one turn are sorted by role, then text. A row is a duplicate if its conversation has role and text at an earlier turn, found
    by a grouped minimum and a join on digests, or directly before it at the same one.
    """
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    r = rows.withColumn("same", F.unhex(same))
    first = r.where("live").groupBy(F.col("conv_id").alias("first_id"), F.col("same").alias("first_same")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    r = r.join(first, F.col("conv_id").eqNullSafe(F.col("first_id")) & (F.col("same") == F.col("first_same")), "left")
    later = F.col("live") & F.col("first").isNotNull() & F.col("turn").isNotNull() & (F.col("first.turn").isNull() | (F.col("turn") > F.col("first.turn")))
    r = r.select("conv_id", "turn", "role", "text", "live", F.coalesce(later, F.lit(False)).alias("later"))
    session = rows.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), rows.count() // plan.part_rows + 1)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("live")]
    dealt = r.withColumn("head", F.substring("text", 1, 64)).repartitionByRange(parts, *order[:3], F.asc("head")).drop("head")  # bounds of parts hold no whole texts
    # faults are told after the shuffle: before it, the sample that its bounds come from would tell them too
    fault = faults(F.col("role"), F.col("text"))
    kind = F.coalesce(F.nullif(F.instr(F.lit(CLASSES), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    kind = F.when(F.col("role") == "", 3).otherwise(kind)
    code = F.when(~F.col("live"), DROPPED).otherwise(4 * kind + F.when(fault == BLANK, fault).when(F.col("later"), DUPLICATE).otherwise(fault))
    dealt = dealt.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", code.cast("int").alias("code"), F.spark_partition_id().alias("part"))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            codes = b.column("code").to_pylist()
            rows = zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True)
            for k, row in enumerate(rows):
                if codes[k] == DROPPED:
                    continue
                if row == before and codes[k] % 4 != BLANK:
                    codes[k] = codes[k] // 4 * 4 + DUPLICATE
                before = row
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()) if c == "code" else b.column(c) for c in b.schema.names], names=b.schema.names)

    return durable(dealt.mapInArrow(repeated, dealt.schema))


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, object, list[tuple]]]:
    """(part, conv_id, rows) of the conversations in a part, or what the part has of them."""
    key, held = None, []
    for b in batches:
        for part, conv, *row in zip(*(b.column(c).to_pylist() for c in ("part", "conv_id", *columns)), strict=True):
            if (part, conv) != key:
                if held:
                    yield *key, held
                key, held = (part, conv), []
            held.append(tuple(row))
    if held:
        yield *key, held


Borders = dict[tuple[int, object], tuple[frozenset[int], Costs, bool]]


def _borders(rows: DataFrame, plan: RepairPlan) -> Borders:
    """For each part of a divided conversation: the states in which it begins, the costs behind it, and if it is the last.

    The driver holds an entry for each of these parts, fewer than twice as many as there are parts of the table.
    """
    ends = rows.groupBy("part").agg(F.min(F.struct("conv_id")).alias("a"), F.max(F.struct("conv_id")).alias("b")).orderBy("part").collect()
    divided = {y["a"][0] for x, y in zip(ends, ends[1:], strict=False) if x["b"][0] == y["a"][0]}
    if not divided:
        return {}
    named = [x for x in divided if x is not None]
    theirs = F.col("conv_id").isin(named) if named else F.lit(False)
    theirs = theirs | F.col("conv_id").isNull() if None in divided else theirs
    some = rows.where(theirs).select("part", "conv_id", "code")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(part, conv, matrix([c for (c,) in held], plan)) for part, conv, held in _chunks(batches, ["code"])]
        yield _batch(found, ["part", "conv_id", "m"], [pa.int32(), None, pa.list_(pa.int64())])

    parts: dict[object, list] = {}
    for x in some.mapInArrow(matrices, f"part int, conv_id {kind}, m array<long>").collect():
        parts.setdefault(x["conv_id"], []).append((x["part"], x["m"]))
    behind: dict[tuple[int, object], Costs] = {}
    tight: dict[tuple[int, object], frozenset[int]] = {}
    for conv, found in parts.items():
        found.sort()
        costs = end_costs(plan)
        for part, m in reversed(found):
            behind[part, conv] = costs
            costs = tuple(min(m[4 * q + r] + costs[r] for r in STATES) for q in STATES)
        total, front = costs[BEGIN], (0, FAR, FAR, FAR)
        for part, m in found:
            after = behind[part, conv]
            before = tuple(min(m[4 * q + r] + after[r] for r in STATES) for q in STATES)
            tight[part, conv] = frozenset(q for q in STATES if front[q] + before[q] == total)
            front = tuple(min(front[q] + m[4 * q + r] for q in STATES) for r in STATES)
    entries = [(part, conv, list(behind[part, conv]), sorted(tight[part, conv])) for part, conv in behind]
    known = {(part, conv): (costs, states) for part, conv, costs, states in entries}

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for part, conv, held in _chunks(batches, ["code"]):
            codes = [c for (c,) in held]
            after, states = known[part, conv]
            costs = backward(codes, tuple(after), plan)
            for q in states:
                found.append((part, conv, q, sorted(traverse(codes, costs, frozenset([q]), False, plan)[1])))
        yield _batch(found, ["part", "conv_id", "q", "r"], [pa.int32(), None, pa.int32(), pa.list_(pa.int32())])

    leads = {(x["part"], x["conv_id"], x["q"]): frozenset(x["r"]) for x in some.mapInArrow(exits, f"part int, conv_id {kind}, q int, r array<int>").collect()}
    out: Borders = {}
    for conv, found in parts.items():
        states = frozenset([BEGIN])
        for part, _ in found:
            out[part, conv] = (states, behind[part, conv], part == found[-1][0])
            states = frozenset(r for q in states for r in leads[part, conv, q])
    return out


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) if t is not None else pa.array(c, pa.int64() if not c else None) for c, t in zip(columns, types, strict=True)], names=names)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 1000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches, each of so many rows or, counting texts and bytes, of about so many bytes at most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _repaired(borders: Borders, plan: RepairPlan, columns: list[str], batches: Iterator[pa.RecordBatch]):
    """(part, conv_id, rows, edits, divided, last) of each conversation in a part; columns begin with code."""
    for part, conv, held in _chunks(batches, columns):
        divided = (part, conv) in borders
        states, after, last = borders.get((part, conv), (frozenset([BEGIN]), end_costs(plan), True))
        codes = [row[0] for row in held]
        edits, _ = traverse(codes, backward(codes, after, plan), states, last, plan)
        yield part, conv, held, edits, divided, last


def _told(held: list[tuple], edit: tuple[str, int, int]) -> tuple[str, str]:
    """(role, text) of the turn that an edit leaves; rows are (code, role, text, ...)."""
    letter, at, state = edit
    if letter == "I":
        return ROLE[state], ""
    return (held[at][1] if letter == "K" else ROLE[state]), held[at][2]


def _prepared(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), null roles and texts being one space."""
    c = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    return c.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def repaired_turns(conversations: DataFrame, plan: RepairPlan = RepairPlan()) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every conversation after its repair, `place` rising within it.

    Null roles and texts count as one space, null turns come first, rows of one turn are sorted by role, then text. Repeated rows
    are duplicates and go. Rows without conv_id are one conversation. Conversations of any length are repaired in parts; a text lies in
    one task whole. An empty table gives an empty result; columns beside conv_id, turn, role and text are not looked at.
    """
    rows = _sorted_rows(_prepared(conversations).withColumn("live", F.lit(True)), plan)
    borders = _borders(rows, plan)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part, conv, held, edits, _, _ in _repaired(borders, plan, ["code", "role", "text"], batches):
            yield from ((conv, (part << 32) + k, e[0], *_told(held, e)) for k, e in enumerate(edits) if e[0] != "D")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(turns(batches), schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _arrow(kind)), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return rows.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LEGAL = {"su", "ua", "au"}


def _piece_rows(borders: Borders, plan: RepairPlan, schema: pa.Schema):
    """For each conversation in a part its counts, the turns and initials at its ends, its audit, and either the digest or the
    text of its turns, where it goes on in another part."""

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part, conv, held, edits, divided, _ in _repaired(borders, plan, ["code", "role", "text", "turn"], batches):
            live = [row for row in held if row[0] != DROPPED]
            found = [row[0] % 4 for row in live]
            initials = [row[1][:1] for row in live]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            turns = [row[3] for row in live if row[3] is not None]
            cost = sum({"I": plan.insert, "D": plan.delete, "K": 0, "R": plan.rerole}[x] + plan.truncated * (x in "KR" and held[k][0] % 4 == TRUNCATED) for x, k, _ in edits)
            lines = [f"{role}:{text}" for role, text in (_told(held, e) for e in edits if e[0] != "D")]
            whole = "\n".join(lines).encode("utf-8", "surrogatepass")
            told = (None, whole) if divided else (hashlib.sha256(whole).hexdigest(), None)
            row = (conv, part, found.count(BLANK), found.count(DUPLICATE), found.count(TRUNCATED), illegal, cost, len(live), *((initials[0], initials[-1]) if live else (None, None)))
            yield (*row, *((turns[0], turns[-1]) if turns else (None, None)), len(set(turns)), "".join(x for x, _, _ in edits), len(lines), *told)

    return lambda batches: _batched(found_in(batches), schema)


def _joined(out: pa.Schema):
    """The rows of conversations, from those of their parts in order; the text of a divided one is digested piece by piece."""

    def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        state: dict | None = None

        def emit() -> tuple:
            gaps = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
            return state["conv"], gaps, *state["n"], "".join(state["audit"]), state["digest"] or state["sha"].hexdigest()

        for b in batches:
            for r in b.to_pylist():
                if state is None or state["conv"] != r["conv_id"]:
                    if state is not None:
                        yield emit()
                    state = {"conv": r["conv_id"], "n": [0] * 5, "turns": 0, "first": None, "last": None, "initial": None, "audit": [], "lines": 0, "sha": hashlib.sha256(), "digest": r["digest"]}
                for k, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                    state["n"][k] += r[c]
                if r["rows"]:
                    if state["initial"] is not None:
                        state["n"][3] += state["initial"] + r["first_initial"] not in LEGAL
                    state["initial"] = r["last_initial"]
                if r["turns"]:
                    state["turns"] += r["turns"] - (state["last"] == r["first_turn"])
                    state["first"] = r["first_turn"] if state["first"] is None else state["first"]
                    state["last"] = r["last_turn"]
                state["audit"].append(r["audit"])
                if r["lines"] and r["piece"] is not None:
                    state["sha"].update(b"\n" * bool(state["lines"]) + r["piece"])
                state["lines"] += r["lines"]
        if state is not None:
            yield emit()

    return lambda batches: _batched(conversations_of(batches), out)


def audited(rows: DataFrame, plan: RepairPlan = RepairPlan()) -> DataFrame:
    """One row a conversation of rows (conv_id, turn, role, text, live): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. Rows that aren't live only tell that their conversation exists.

    The digest of a divided conversation and its audit, a letter a row, are made in one task, piece by piece: a digest has no parts.
    """
    rows = _sorted_rows(rows, plan)
    borders = _borders(rows, plan)
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    names = {"conv_id": conv, "part": "int", **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "rows"), "bigint"), "first_initial": "string", "last_initial": "string", "first_turn": turn, "last_turn": turn, "turns": "bigint", "audit": "string", "lines": "bigint", "digest": "string", "piece": "binary"}
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in names.items()])
    result = {"conv_id": conv, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "repaired_sha256": "string"}
    pieces = rows.mapInArrow(_piece_rows(borders, plan, schema), ", ".join(f"{n} {k}" for n, k in names.items()))
    pieces = pieces.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part")
    return pieces.mapInArrow(_joined(pa.schema([(n, kinds[k]) for n, k in result.items()])), ", ".join(f"{n} {k}" for n, k in result.items()))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live): conversations damaged by crc32 of `conv_id:turn`, with nulls as one space; dropped rows aren't live."""
    c = _prepared(conversations)
    shown = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    c = c.withColumn("h", F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20)
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    c = c.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("h") != 0).alias("live"), "h")
    return c.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text", "live")


def repair_query(conversations: DataFrame, plan: RepairPlan = RepairPlan()) -> DataFrame:
    """The audit of every conversation after its damage; rules for rows are those of repaired_turns, a conversation whose rows
    are all dropped has zeros, an empty audit and the digest of nothing."""
    bound_batches(conversations.sparkSession)
    return audited(damaged(conversations), plan)
