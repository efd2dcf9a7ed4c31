import pytest

import __spark_entry__ as e
from gridledger.plans import queries as core
from tests.oracle import compare

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    compare(core.queries()[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert core.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert e.entry(spark).count() == 1
    assert set(core.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
