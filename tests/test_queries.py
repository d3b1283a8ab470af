import pytest
from oracle import assert_same

from tessera.plans import answer_queries, pipeline_queries, retrieval_queries, store_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = retrieval_queries.R.queries | answer_queries.R.queries | pipeline_queries.R.queries | store_queries.R.queries
SQL = retrieval_queries.R.sql | answer_queries.R.sql | pipeline_queries.R.sql | store_queries.R.sql


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 60


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, FOLDER, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
