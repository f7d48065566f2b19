"""Every registered query against its SQL text at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from rasterledger.fixtures import TABLES
from tools.check_oracle import DUCK_TYPE, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    kinds = {d[0]: str(d[1]).upper() for d in cur.description}
    assert {c: DUCK_TYPE[t] for c, t in df.dtypes} == kinds
    assert rows(df.columns, got) == rows(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["slide", "status", "severity", "confidence", "tolerance_applied"]
