"""Every registered query against its SQL, and rules its plan must keep."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry
from checks import load_all
from checks.registry import ORACLES, QUERIES
from tools.check_oracle import rows as comparable

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = comparable(df.columns, df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert got == comparable(names, result.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Python only where no built-in can do it: the recursive JSON merge.
    assert ("Python" not in plan) or "_merge_batch" in plan


def test_entry(spark):
    assert entry(spark).columns[:2] == ["kind", "dim"] and entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
