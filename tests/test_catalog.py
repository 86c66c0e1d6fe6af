"""Every catalogue query against its SQL form on the smallest tables."""

import os

import pytest
from helpers import duck, table

from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_its_sql(spark, connection, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = connection.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
    spark.catalog.clearCache()


def test_entry_has_rows(spark):
    assert catalog.entry(spark, SF).count() > 0


def test_entry_point_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
