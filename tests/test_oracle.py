"""Every registered query with SQL against DuckDB on the smallest scale; the others must return rows."""

import pytest

from emberwatch.queries.catalog import oracle_sql, queries
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in queries()])
def test_query(spark, con, name):
    result = compare(spark, con, FOLDER, name)
    if name in oracle_sql():
        assert result.startswith("exact") and "types" not in result, result
    else:
        assert result.startswith("rows only") and result != "rows only: 0", result
