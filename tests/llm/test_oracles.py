import pytest

import __spark_entry__ as contract
from tests.compare import database, duckdb_result, spark_result
from wikiloom.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, key):
    columns, rows = spark_result(QUERIES[key](spark, SF_DIR))
    assert (columns, rows) == duckdb_result(database(SF_DIR), ORACLE_SQL[key])
    assert rows


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
