"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from compare import DATA, connect, same

from sylvaframe.plans import registry

FOLDER = f"{DATA}/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_as_sql(spark, con, key):
    same(registry.queries()[key](spark, FOLDER), con, SQL[key])


@pytest.mark.parametrize("key", sorted(set(registry.queries()) - set(SQL)))
def test_runs_without_sql(spark, key):
    assert registry.queries()[key](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
