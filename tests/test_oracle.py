import pytest

import __spark_entry__ as entry
from oracle import DATA, assert_matches

SQL = entry.registry.sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_matches(spark, entry.registry.queries()[name], SQL[name], f"{DATA}/sf0.001")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
