"""Every query with an oracle against DuckDB, on whole tables. ``ORACLE_SF`` chooses the scale (default 0.001)."""

import os

import pytest

import __spark_entry__ as entry
from oracle import TESTDATA, connect, difference

SF_DIR = f"{TESTDATA}/sf{os.environ.get('ORACLE_SF', '0.001')}"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_DIR)
    problem = difference(df, con, ORACLES[key])
    assert problem is None, problem
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, key):
    assert QUERIES[key](spark, SF_DIR).count() > 0


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 28
