"""Every query with a DuckDB twin must agree with it row for row; the others must run."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = connect(folder)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, folder, name):
    assert compare(QUERIES[name](spark, folder).toPandas(), duck.sql(ORACLES[name]).df()) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["event_id", "meter_id"]
