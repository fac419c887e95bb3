"""Each registered query against its SQL at the smallest scale, and its plan."""

import oracle_check as oc
import pytest
from frames import SMALL

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oc.duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, con):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = oc.spark_rows(df)
    if name in ORACLES:
        assert oc.compare(got, oc.sql_rows(con, ORACLES[name])) == "ok"
        assert oc.type_notes(con, ORACLES[name], df) == ""


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
