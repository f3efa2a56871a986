"""Every registered query with SQL gives the SQL's rows; the others run."""

import oracle
import pytest

from basalt import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, name):
    assert oracle.differs(spark, small, catalog.queries()[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
