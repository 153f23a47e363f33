"""Every registered query against its DuckDB SQL on the smallest data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, open_db
from tests.conftest import TEST_DATA
from vitalspark.plans.catalog import load_all

SF = str(TEST_DATA / "sf0.001")


@pytest.fixture(scope="module")
def db():
    return open_db(SF)


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query_matches_sql(spark, db, name):
    rows, ok, note = compare(spark, db, SF, name, queries()[name], oracle_sql().get(name))
    assert ok is not False, note
    assert rows >= 0


def test_entry(spark):
    df = entry(spark)
    assert "estimated_1rm" in df.columns
    assert df.count() > 0
