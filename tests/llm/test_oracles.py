"""Every query of the subpackage with check SQL against DuckDB; the others run."""

import pytest
from compare import canonical, duck

from itemspark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    answer = duck(FOLDER).execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(answer.fetchall(), names)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_entry_points():
    entry = __import__("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
