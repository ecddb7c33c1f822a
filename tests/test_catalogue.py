"""Every registered query against its SQL, on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillspan.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    assert found
    if name in ORACLE_SQL:
        cur = db.execute(ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, found) == rows(names, cur.fetchall())
