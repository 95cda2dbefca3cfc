import pytest

from deepledger.llm.queries import ORACLES
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    check(spark, name)
