import pytest

from oracle import same
from quernel import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, folder, name):
    same(queries.QUERIES[name](spark, folder), queries.ORACLES[name], folder)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["sum"]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
