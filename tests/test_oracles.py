import pytest

import __spark_entry__ as entry
from tools.check import canonical, connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, sf, con, key):
    df = entry.queries()[key](spark, sf)
    got = df.toPandas()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = con.execute(entry.oracle_sql()[key]).df()
    assert differences(canonical(got), canonical(want)) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
