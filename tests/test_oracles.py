import pytest

import __spark_entry__ as contract
from fixtures.queries import QUERIES
from tests.compare import database, duckdb_result, spark_result

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return database(SF_DIR)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, connection, key):
    columns, rows = spark_result(contract.queries()[key](spark, SF_DIR))
    expected_columns, expected = duckdb_result(connection, contract.oracle_sql()[key])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())
