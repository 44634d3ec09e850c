"""Every query of the library proper against its SQL on the smallest tables."""

import pytest

from tests.conftest import SF, oracle_rows, rows_of
from veritrail.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, oracle, name):
    assert rows_of(registry.QUERIES[name](spark, SF)) == oracle_rows(oracle, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
