"""Every query of the record engine against its SQL."""

import pytest

from recordmill.plans import catalogue

ORACLES = catalogue.oracle_sql()
NO_SQL = sorted(set(catalogue.queries()) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf_dir, duck, same):
    same(catalogue.queries()[name](spark, sf_dir), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", NO_SQL)
def test_runs(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
