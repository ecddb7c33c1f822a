"""Queries of the corpus operators against their SQL."""

import random
from pathlib import Path

import duckdb
import pytest

from quillspan.llm import decontam, repair
from quillspan.llm.queries import ORACLE_SQL, QUERIES


def same(df, db, name):
    cur = db.execute(ORACLE_SQL[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == sorted(df.columns)
    found = sorted(tuple(r) for r in df.select(*order).collect())
    assert found == sorted(cur.fetchall())
    return found


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_small_tables(spark, name):
    db = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert same(QUERIES[name](spark, "/root/testdata/sf0.001"), db, name)


def test_slots(spark):
    """Names of two letters in a row, digits in names, units, clashes, repeated rows and nulls."""
    item = "Then Al Bo Anna9 Smith drove 40 km and 5% more to the old harbor town, and Anna9 paid 7 dollars for the ferry"
    told = "so Then Cy Di Maria8 Jones drove 95 km and 6% more to the old harbor town, and Maria8 paid 3 dollars for the ferry."
    anna, maria = ("%s has %s apples. %s buys %s more apples. How many apples does %s have?" % x for x in (("Anna", "1,250", "Anna", "7", "Anna"), ("Maria", "30", "Maria", "9.5", "Maria")))
    common = "The old ferry leaves the harbor town at dawn and comes back at dusk"
    names = "It was Li and Ro. Li went, Ro-Li stayed, li Ro2 Li\nRo Li"
    sums = "What is 12 + 7 * 3 - 4?"
    docs = [(8, maria), (9, f"so {common}."), (10, f"he said {common}. The End of the story"), (11, f"x {sums} y"), (12, sums.replace("7", "8")), (13, names), (14, names.replace("Li", "Su"))]
    copied = "a river runs past the quiet mill and then it turns south before the bridge where two old roads meet again"
    apples = copied + ". %s apples cost %s dollars there, and %s more are free"
    docs += [(20, apples % (3, 9, 9)), (21, apples % (3, 3, 4)), (22, "Five roads and " + (apples % (8, 8, 7)).replace(copied, "no river at all"))]
    docs += [(1, told), (1, told), (2, told.replace("Maria8 paid", "Peter paid")), (3, item.upper()), (4, None), (5, ""), (None, item), (6, "one short whole item text"), (7, f"x{item} Été Ωmega")]
    items = [(10, apples % (5, 5, 5)), (6, anna), (7, common), (8, sums), (9, names), (1, item), (1, item), (2, None), (3, "short whole item"), (4, "whole item text here and there"), (5, "A one short whole item"), (None, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    found = same(decontam.leaks(d, b), db, "op10_decontamination")
    pairs = {(r[0], r[1]) for r in found}
    assert pairs >= {(1, 1), (7, 1), (8, 6), (9, 7), (10, 7), (11, 8), (13, 9), (20, 10), (21, 10)} and not {(12, 8), (22, 10)} & pairs
    assert {r[0]: (r[2], r[3]) for r in found if r[1] == 10}[20] == (21, 0)  # the 21 words of the copied passage, up to the first slot that clashes


def test_conversations(spark):
    """Nulls, ties, repeated rows, unknown roles, gaps and conversations of many turns."""
    rng = random.Random(6)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "sys"], ["Yes.", "no", "", " \t", "Well! ", None, "a?"]
    rows = [(c, None if rng.random() < 0.05 else k * rng.choice([1, 1, 2]), ("user", "assistant")[k % 2] if rng.random() < 0.6 else rng.choice(roles), f"text {k}." if rng.random() < 0.6 else rng.choice(texts)) for c in [*range(150), None] for k in range(rng.randint(1, 14))]
    rows += rows[:20]
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = repair.repair_query(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    cur = db.execute(ORACLE_SQL["op13_conversation_repair"])
    assert [d[0] for d in cur.description] == found.columns
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, cur.fetchall()))
