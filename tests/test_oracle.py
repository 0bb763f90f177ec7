"""Every registered query against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import canon, duck

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(D)


@pytest.mark.parametrize("name", list(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon(df.columns, rows) == canon(cols, cur.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
