"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import difference, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    found = entry(spark)
    assert found.columns[:3] == ["model_id", "window_id", "node"]
    assert found.count() == 7 * found.select("model_id", "window_id").distinct().count()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    found = difference(spark, con, queries()[name], oracle_sql().get(name), SF)
    # At this size a few results are legitimately empty on both sides.
    assert found in (None, "no rows"), found
