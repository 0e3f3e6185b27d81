import pytest

from farewright.llm.queries import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
