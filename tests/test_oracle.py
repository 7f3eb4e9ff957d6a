"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

from compare import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    from cutline.catalog import oracle, queries

    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    found = difference(spark, con, QUERIES[name], ORACLE[name], SF_DIR)
    assert found is None or found.startswith("EMPTY")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
