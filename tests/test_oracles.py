import __spark_entry__
import pytest
from oracles import compare, connect

from quire import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_oracle(spark, duck, name):
    assert compare(spark, duck, FOLDER, registry.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_oracle_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
