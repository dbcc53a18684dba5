"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from paperloom.catalog.compare import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    assert compare(spark, SF_DIR, name, connection) is None


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
