"""Every registered query at the smallest scale: against its oracle where there is one, else for rows and schema."""

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        problem, _ = compare(df, con, ORACLES[name])
        assert problem is None, problem
    else:
        assert df.columns and df.collect() is not None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["language", "reason", "n_docs", "n_tokens"] and out.count() > 0
