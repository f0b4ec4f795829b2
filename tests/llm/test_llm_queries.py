import glob
import os

import duckdb
import pytest

from tandem.llm.oracles import ORACLES
from tandem.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_recall(spark):
    assert QUERIES["p5_recall"](spark, DATA).first().recall in (None, 1.0)
