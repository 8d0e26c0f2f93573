"""Every query with an SQL form gives the SQL's rows on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, differences, spark_rows, sql_rows

SF = os.environ.get("KOHORTA_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: Full parameter sweeps: minutes of fits, run by the benchmark and the oracle check instead.
SWEEPS = {"best_k_gap", "candidate_ks", "evaluate_k", "aic_bic_sweep"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = spark_rows(entry.queries()[name](spark, SF))
    assert differences(got, sql_rows(con, entry.oracle_sql()[name])) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SWEEPS))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
