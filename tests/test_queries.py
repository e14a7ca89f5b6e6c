import pytest

from trackweave import queries

from .conftest import SF
from .oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
