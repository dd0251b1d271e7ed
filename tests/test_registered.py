"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, database

from tidemark.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    good, note = compare(spark, con, QUERIES[name], ORACLES.get(name), sf_dir)
    assert good, note


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
