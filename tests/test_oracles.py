"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(n for m in entry._MODULES for n in m.ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(SMALL):
        if name.endswith(".parquet"):
            con.sql(f"create view {name[:-8]} as select * from '{SMALL}/{name}'")
    return con


def tidy(rows):
    def one(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return repr(round(v, 5) + 0.0)
        return repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are missing")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SMALL)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert tidy(map(tuple, got.select(*(f"`{c}`" for c in columns)).collect())) == tidy(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
