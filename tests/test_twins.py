"""Every registered query gives the rows of its SQL twin."""

import pytest

from checks.catalog import ORACLES, QUERIES
from checks.compare import connect, duckdb_rows, spark_rows


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_twin(name, spark, duck, folder):
    df = QUERIES[name](spark, folder)
    columns, expected = duckdb_rows(duck, ORACLES[name])
    assert sorted(df.columns) == sorted(columns)
    found = spark_rows(df)
    assert len(found) == len(expected)
    assert found == expected
    assert found, "a check on no rows checks nothing"
