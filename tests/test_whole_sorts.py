import pytest
from oracles import connect, plain

from quire import registry
from quire.operators import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["o1_all_newest_first", "o2_all_by_size", "o3_all_products", "o4_all_tasks", "o6_all_numeric_ids"])
def test_all_rows_in_order(spark, name):
    got = registry.queries()[name](spark, FOLDER)
    assert "LIMIT" not in registry.oracle_sql()[name]
    want = connect(FOLDER).execute(registry.oracle_sql()[name]).fetchall()
    assert [tuple(map(plain, r)) for r in got.collect()] == [tuple(map(plain, r)) for r in want]
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()


def test_order_of_a_small_collection(spark):
    rows = [("a", 5, None), ("b", None, 9), ("c", None, None), ("d", 5, 1), ("e", 5, 1), ("f", 7, 0)]
    df = spark.createDataFrame(rows, "id string, update_time long, create_time long").repartition(3)
    ids = lambda x: "".join(r.id for r in x.collect())
    assert ids(catalog.newest_first(df)) == "fedabc"
    df = df.selectExpr("id", "create_time", "update_time as size_bytes", "upper(id) as title")
    assert [ids(catalog.ordered(df, by)) for by in ("newest", "oldest", "name", "size")] == ["bdeacf", "acfdeb", "abcdef", "fadebc"]
    assert ids(catalog.tasks_newest_first(spark.createDataFrame([("a", 3), ("b", None), ("d", 8), ("c", 8), ("e", None)], "id string, created_at long").repartition(3))) == "cdabe"
