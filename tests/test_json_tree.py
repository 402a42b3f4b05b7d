import json
import random

from pyspark.sql import functions as F

from quire.functions import json_tree

BAD = ("__proto__", "constructor", "prototype")


def dangerous(v, depth=0):
    if depth > 20 or not isinstance(v, dict | list):
        return False
    pairs = v.items() if isinstance(v, dict) else enumerate(v)
    return any(k in BAD or dangerous(x, depth + 1) for k, x in pairs)


def tree(rng, depth, share):
    if depth == 0 or rng.random() < 0.1:
        return rng.choice([None, 1, "constructor", '"__proto__":', True, "", "é\\"])
    inner = lambda: tree(rng, depth - 1, share)
    if rng.random() < 0.4:
        return [inner() for _ in range(rng.choice([0, 1, 1, 2]))]
    keys = ["a", "b", 'c":', "proto", "\\", "ü"]
    return {(rng.choice(BAD) if rng.random() < share else rng.choice(keys)): inner() for _ in range(rng.choice([0, 1, 1, 2]))}


def deep(n, key):
    v = {key: 1}
    for i in range(n):
        v = {"x": v} if i % 2 else [v]
    return v


def test_keys_at_any_depth(spark):
    rng = random.Random(7)
    values = [tree(rng, rng.randint(1, 25), 0.05) for _ in range(400)] + [deep(n, "constructor") for n in (0, 1, 18, 19, 20, 21, 22, 25)] + [deep(20, "x")]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5) for v in values]
    odd = [(None, False), ("", False), ("no json __proto__", False), ('{"__proto__":1', False), ('{"a":1,"a":{"prototype":2}}', True), ('{"a":1,"a":"prototype"}', False), ('[{"a":1,"a":2,"constructor" : 3}]', True)]
    rows = [(i, t) for i, t in enumerate(texts + [t for t, _ in odd])]
    df = spark.createDataFrame(rows, "i int, j string").select("i", json_tree.has_dangerous_key("j").alias("hit"))
    got = {r.i: r.hit for r in df.collect()}
    want = [dangerous(v) for v in values] + [hit for _, hit in odd]
    assert [(rows[i][1], got[i]) for i in range(len(rows))] == [(rows[i][1], w) for i, w in enumerate(want)]
    assert 40 < sum(want) < 350
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert spark.range(1).select(json_tree.has_dangerous_key(F.lit('{"a":{"prototype":1}}')).alias("x")).first().x
