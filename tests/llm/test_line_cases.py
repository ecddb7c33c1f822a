"""Line dedup on nulls, repeated ids, clashing columns and empty tables."""

from __future__ import annotations

from quillspan.llm import lines

SCHEMA = "doc_id long, text string, k string, found string, h1 long, `0` string"

A = "a line of the usual length that is long"
NEAR = "a line of the usual length that is lung"
B = "quite another text which has nothing in common"


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [
        (1, f"{A}\n{B}", "k1", "f1", 7, "z"),
        (2, f"{NEAR}\nstays", "k2", None, None, None),
        (3, None, "k3", "f3", 1, "x"),
        (4, "", None, "f4", 1, "x"),
        (5, B, "k5", "f5", 1, "x"),
        (None, f"{A}\n{A}\nx", "k6", "f6", 1, "x"),
        (None, None, "k7", "f7", 1, "x"),
        (1, f"{B}\ntail", "k8", "f8", 1, "x"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lines.remove_repeated_lines(docs)
    assert got.columns == docs.columns
    kept = {r.k if r.k is not None else "none": r for r in got.collect()}
    assert {n: r.text for n, r in kept.items()} == {"k1": f"{A}\n{B}", "k2": "stays", "k3": None, "none": "", "k6": f"{A}\nx", "k7": None, "k8": f"{B}\ntail"}
    assert tuple(kept["k1"]) == rows[0] and kept["k6"].doc_id is None and kept["k6"]["0"] == "x"


def test_empty_table_and_long_line(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lines.remove_repeated_lines(none).columns == none.columns and lines.remove_repeated_lines(none).count() == 0
    assert lines.lines_query(none).count() == 0
    long = "word " * 40_000
    docs = spark.createDataFrame([(1, long + "end", "a", None, None, None), (2, long + "and", "b", None, None, None)], SCHEMA)
    told = {r.doc_id: r for r in lines.lines_query(docs).collect()}
    assert (told[1].n_removed, told[2].n_removed, told[2].n_near) == (0, 1, 1)


def test_lists_of_lines_are_not_broadcast(spark):
    """Whatever the size, the documents meet their lists by a join that a hint doesn't turn into a broadcast."""
    docs = spark.createDataFrame([(k, f"{A}\nown line number {k} of this document", "k", None, None, None) for k in range(50)], SCHEMA)
    plan = lines._deduplicated(docs, lines.LinePlan())._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in plan
