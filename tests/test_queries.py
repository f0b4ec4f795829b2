"""Every query that has a SQL equivalent against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tandem.queries import core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def canon(rows):
    def cell(v):
        if v is None or v != v:
            return "-"
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({core.ORACLES[name]})").fetchall()
    assert canon(map(tuple, df.select(*cols).collect())) == canon(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).columns
