"""Every query with SQL gives the rows the SQL gives; the others hold their invariants."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry_point

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_rows_as_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert {r["fold"] for r in rows} == {0, 1, 2, 3}
    assert all(r["r2"] <= 0 for r in rows)
