"""Every registered query with check SQL, against DuckDB on the middle test tables."""

import importlib

import pytest
from compare import check, duck

from itemspark.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    problem, _ = check(spark, con, name, FOLDER)
    assert problem is None


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 60
