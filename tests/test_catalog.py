"""Every registered query against its SQL, over whole small tables."""

import glob
import os

import duckdb
import pytest

from tidemill.plans import catalog

HERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{HERE}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, HERE)
    cols = sorted(df.columns)
    cur = duck.execute(catalog.ORACLE[name])
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    want = sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want


def test_plans_push_filters_and_prune(spark):
    df = catalog.QUERIES["resume_after"](spark, HERE)
    plan = df._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<event_id:bigint,event_type:string,props:string>" in plan
