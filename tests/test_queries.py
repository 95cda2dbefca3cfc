import pytest

from deepledger.plans.catalogue import ORACLES, QUERIES
from tests.oracle import SF, check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    check(spark, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6000
    assert set(entry.oracle_sql()) <= set(entry.queries())
