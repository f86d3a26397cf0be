"""Every registered query against its SQL on the smallest data set."""

import duckdb
import pytest
from check import TABLES, rows, spark_kind

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_names_and_coverage():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return
    cur = duck.execute(ORACLES[name])
    cols, kinds = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    types = {c: spark_kind(t) for c, t in df.dtypes}
    assert {c: types[c] for c in cols} == dict(zip(cols, kinds))
    assert got == rows(cols, cur.fetchall())
