import pytest

from oracle import DATA, assert_matches
from quotemill.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_matches(spark, QUERIES[name], SQL[name], f"{DATA}/sf0.001")
