import os

import pytest

import __spark_entry__ as entry
from quarrystone.plans import queries as core

SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(core.QUERIES) > 50


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_every_core_query_runs_and_agrees_with_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    for name, run in core.QUERIES.items():
        df = run(spark, SMALL)
        n = len(df.collect())
        if name in core.SQL:
            said = con.execute(core.SQL[name])
            assert sorted(c[0] for c in said.description) == sorted(df.columns), name
            assert len(said.fetchall()) == n, name


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_flagship(spark):
    assert "score" in entry.entry(spark).columns
