"""No change loses data: repeated changes, unreadable JSON, tasks that arrive together."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import json_map, skew
from quire.operators import catalog, store

ACTIVE = ("pending", "running", "ai-pending", "ai-running", "review-pending")
LONG = 123456789012345678901234567890
UNREADABLE = ['{"a":1', "[1]", '{"a":1} x', '{"a":1}{"b":2}', '{"p":{"x":1,"x":2},"m":"y"}', "text", '{"a":1},{"b":2}', '{"a":[1,]}']


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_entries(spark):
    read = lambda j: one(spark, json_map.text(json_map.entries(F.lit(j).cast("string"))))
    assert read(None) == read("") == read("  ") == read("{}") == "{}"
    assert read('{"b":1,"a":2,"b":[null,{"c":"3"}]}') == '{"a":2,"b":[null,{"c":"3"}]}'
    assert read('{"n":%d,"s":"1"}' % LONG) == '{"n":%d,"s":"1"}' % LONG
    assert [read(j) for j in UNREADABLE] == [None] * len(UNREADABLE)
    df = spark.createDataFrame([(j,) for j in UNREADABLE], "j string")
    assert [r.x for r in df.select(json_map.readable(F.col("j")).alias("x")).collect()] == [False] * len(UNREADABLE)


@pytest.mark.parametrize("old", UNREADABLE)
def test_what_cannot_be_read_keeps_its_text(spark, old):
    new = '{"n":1,"mineruExecutionProfile":{"x":1}}'
    j, n = F.lit(old), F.lit(new)
    for changed in (json_map.merged(j, n), store.task_metadata(j, n), store.new_run(j, n), catalog.suppressed(j), json_map.without(j, ("a",))):
        assert one(spark, changed) == old
    for changed in (json_map.merged(n, j), store.task_metadata(n, j), store.new_run(n, j)):
        assert one(spark, changed) == new
    rows = spark.createDataFrame([("1", "t", old), ("2", "t", new)], "id string, title string, metadata string")
    changes = spark.createDataFrame([("1", '{"title":"u","metadata":{"n":2}}'), ("2", old)], "id string, body string")
    assert sorted(map(tuple, store.patch_json(rows, changes).collect())) == [("1", "u", old), ("2", "t", new)]
    assert sorted(map(tuple, store.unreadable(rows, changes).collect())) == [("1", "metadata", old), ("2", "body", old)]
    tasks = spark.createDataFrame([("1", "running", "oops", old)], "id string, state string, error_message string, metadata string")
    assert tuple(store.recovered(tasks).first())[2:] == ("oops", old)


def patched(row, bodies):
    """The rule, one body after another."""
    for body in bodies:
        meta = row["metadata"]
        row = {**row, **{k: v for k, v in body.items() if k in row}}
        if body.get("metadata"):
            row["metadata"] = {**(meta if isinstance(meta, dict) else {}), **body["metadata"]} if isinstance(body["metadata"], dict) else body["metadata"]
        elif "metadata" in body:
            row["metadata"] = {**(meta if isinstance(meta, dict) else {})} if isinstance(body["metadata"], dict) else body["metadata"]
    return row


def test_bodies_of_one_key_are_applied_in_order(spark):
    rng = random.Random(4)
    value = lambda: rng.choice([None, 1, "x", True, [1, {"a": None}], {"y": rng.randrange(9)}, LONG])
    old = {str(i): {"title": f"t{i}", "stage": None, "metadata": {rng.choice("abc"): value() for _ in range(3)}} for i in range(40)}
    bodies = {k: [{n: v for n, v in (("title", value()), ("stage", value()), ("metadata", rng.choice([None, "text", {rng.choice("abcd"): value()}, {rng.choice("abcd"): value()}, {}])), ("odd", 1)) if rng.random() < 0.6} for _ in range(rng.randrange(6))] for k in old}
    rows = spark.createDataFrame([(k, v["title"], v["stage"], json.dumps(v["metadata"])) for k, v in old.items()], "id string, title string, stage string, metadata string")
    arrived = [(k, n, json.dumps(b)) for k, bs in bodies.items() for n, b in enumerate(bs)]
    rng.shuffle(arrived)
    got = store.patch_json(rows, spark.createDataFrame(arrived, "id string, n int, body string"), order="n").collect()
    assert len(got) == 40
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    for r in got:
        want = patched(old[r.id], bodies[r.id])
        assert (r.title, r.stage) == (text(want["title"]), text(want["stage"]))
        assert (json.loads(r.metadata) if isinstance(want["metadata"], dict) else r.metadata) == want["metadata"]


def test_last_change_of_a_key_counts(spark):
    rows = spark.createDataFrame([("1", "a", {"k": 1}), ("2", "b", None)], "id string, title string, m map<string,int>")
    changes = spark.createDataFrame([("1", "z", None, 1), ("1", "c", {"k": 2}, 2), ("3", "d", {"x": 9}, 3)], "id string, title string, m map<string,int>, n int")
    got = {r.id: (r.title, r.m) for r in store.upsert(rows.withColumn("n", F.lit(0)), changes, order="n").collect()}
    assert got == {"1": ("c", {"k": 2}), "2": ("b", None), "3": ("d", {"x": 9})}
    got = store.patch(rows, changes.where("id = '1'").withColumn("title", F.when(F.col("n") == 1, F.col("title"))), ["title", "m"], order="n").collect()
    assert {r.id: (r.title, r.m) for r in got} == {"1": ("z", {"k": 2}), "2": ("b", None)}


def arrived(incoming, tasks):
    """The rule, one task after another."""
    there = {t[0]: t for t in tasks}
    out = {}
    for n, (key, owner, state, at) in sorted(enumerate(incoming), key=lambda x: (x[1][3] is not None, x[1][3] or 0, x[1][0])):
        busy = owner and any(t[1] == owner and t[2] in ACTIVE for t in there.values())
        out[n] = key not in there and bool(busy)
        if not out[n]:
            there[key] = (key, owner, state, at)
    return [out[n] for n in range(len(incoming))]


@pytest.mark.parametrize("hot", [10_000, 5])
def test_tasks_that_arrive_together(spark, monkeypatch, hot):
    """At most one active task an owner: owners already busy, known tasks, an owner with a third of the rows, blank owners."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rng = random.Random(6)
    states = [*ACTIVE, "completed", "failed"]
    owner = lambda: rng.choice(["hot"] * 4 + [f"m{rng.randrange(60)}"] * 6 + ["", None])
    tasks = [(f"t{i}", f"m{rng.randrange(60)}", rng.choice(states), i) for i in range(40)]
    # a task that is there keeps its owner
    incoming = [(f"n{i}", owner(), rng.choice(states), rng.choice([None, rng.randrange(30)])) for i in range(300)] + [(*t[:2], rng.choice(states[5:]), 5) for t in tasks[:10] if t[2] not in ACTIVE]
    schema = "id string, material_id string, state string, created_at int"
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(incoming)], schema + ", nr int")
    got = {r.nr: r.conflict for r in store.insert_unless_active(df, spark.createDataFrame(tasks, schema), ACTIVE).collect()}
    assert [got[n] for n in range(len(incoming))] == arrived(incoming, tasks) and 50 < sum(got.values()) < 290
    accepted = [r for n, r in enumerate(incoming) if not got[n] and r[1] and r[2] in ACTIVE]
    assert len({r[1] for r in accepted}) == len(accepted)
    assert store.insert_unless_active(df.limit(0), spark.createDataFrame(tasks, schema), ACTIVE).count() == 0
