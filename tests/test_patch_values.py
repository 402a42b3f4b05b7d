"""Values of patches stay values: no text of them is made to be read again."""

import json

import pytest
from pyspark.sql import functions as F

from quire import registry
from quire.functions import json_map
from quire.operators import store

LONG = 123456789012345678901234567890


@pytest.mark.parametrize("name", ["m4_json_puts_in_order", "m2_json_patches_in_order", "m4_json_merge_put", "m2_json_patch"])
def test_values_are_not_read_again(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 0 and plan.count("StructsToJson") == 1  # the merged metadata


def test_what_has_no_braces_at_its_ends_is_unreadable(spark):
    texts = ['{"a":1}]', ' \t\n{"a":1}\r\n ', '["a"]', "null", '{"a":1', 'a":1}', "{", "}", " \n", "{}", None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, j string").select("n", json_map.text(json_map.entries(F.col("j"))).alias("x"))
    assert [r.x for r in rows.orderBy("n").collect()] == [None, '{"a":1}'] + [None] * 7 + ["{}", "{}"]


@pytest.mark.parametrize("insert", [True, False])
def test_bodies_of_all_kinds(spark, insert):
    """Keys without a row, the empty key, columns that do not exist, nulls, and metadata of every kind, in the order of ``n``."""
    bodies = {
        "new": ["{}"], "blank": [""], "broken": ["{", '{"title":1}{}'], "odd": ['{"odd":1,"":2}'], "gave": ['{"title":"x","stage":null}'], "text": ['{"metadata":"t"}'], "object": ['{"metadata":{}}'],
        "a": ['{"title":"x"}', '{"title":null}'], "b": ['{"metadata":{"k":1,"":{"y":[%d]}}}' % LONG, '{"metadata":{"k":"1","m":null}}'], "c": ['{"metadata":{"p":1}}', '{"metadata":[1]}', '{"metadata":{"q":true}}'],
        "d": ['{"metadata":{"p":1},"metadata":{"q":2}}', '{"metadata":null}'], "e": ['{"title":{"x":1.50}}', '{"stage":"s","":0}'],
    }
    rows = spark.createDataFrame([(k, "t", "s", '{"old":1,"k":0}') for k in "abcdef"], "id string, title string, stage string, metadata string")
    changes = spark.createDataFrame([(k, n, b) for k, bs in bodies.items() for n, b in enumerate(bs)][::-1], "id string, n int, body string")
    got = {r.id: tuple(r)[1:3] + ((json.loads(r.metadata) if (r.metadata or "")[:1] in "{[" and r.metadata else r.metadata),) for r in store.patch_json(rows, changes, insert=insert, order="n").collect()}
    old = {"old": 1, "k": 0}
    want = {"a": (None, "s", old), "b": ("t", "s", {"": {"y": [LONG]}, "k": "1", "m": None, "old": 1}), "c": ("t", "s", {"q": True}), "d": ("t", "s", None), "e": ('{"x":1.5}', "s", old), "f": ("t", "s", old)}
    if insert:
        want |= {"c": ("t", "s", {**old, "p": 1, "q": True}), "d": ("t", "s", {**old, "q": 2})}
        want |= {"new": (None, None, {}), "blank": (None, None, {}), "odd": (None, None, {}), "gave": ("x", None, {}), "text": (None, None, {}), "object": (None, None, {})}
    assert got == want
