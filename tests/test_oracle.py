import pytest

from farewright.plans import board_queries, history_queries, page_queries, queries
from tests.oracle import same

assert page_queries and history_queries and board_queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_every_query_has_a_twin():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
