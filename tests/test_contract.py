"""Every registered query against its oracle on the smallest tables."""

import pytest

import __spark_entry__ as contract
import check

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["tenant_id", "order_day"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    diff = check.compare(spark, duck, SF, QUERIES[name], ORACLES[name])
    # At this scale a report's window may hold no row; the larger scales cover those.
    assert diff in (None, "EMPTY"), diff


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
