import math
import random

import duckdb

from quire.llm import ball_tree


def brute(rows, every=50, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(whole):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(whole) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, shard int, score double")
    return sorted(map(tuple, ball_tree.top_k(df, **options).collect()))


def test_against_brute_force(spark):
    rng = random.Random(8)
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f32(rng.gauss(0, 0.2)) for _ in range(12)]) for i in range(1500)]
    same = rows[17][1]
    rows += [(i, same) for i in range(2000, 2700)]  # many ties
    rows += [(3000, None), (3050, [1.0, None] + [0.0] * 10), (3100, [float("nan")] * 12), (3150, [float("inf")] * 12), (None, same), (3200, []), (3250, [0.5]), (-50, [f32(-0.1)] * 12), (100, rows[3][1])]
    assert run(spark, rows) == brute(rows)
    few = rows[:4] + [(50, rows[9][1])]
    assert run(spark, few) == brute(few)
    assert run(spark, []) == [] and run(spark, [(50, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**21)), float(i)]) for i in range(0, 300)]
    assert run(spark, rows, every=100) == brute(rows, 100)


def test_whole_small_table(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}'").fetchall()
    got = sorted(map(tuple, ball_tree.top_k(spark.read.parquet(path)).collect()))
    assert got == brute(rows)


def test_several_rows_of_an_id_are_rows(spark):
    rows = [(50, [1.0, 0.0]), (50, [2.0, 0.0]), (50, [2.0, 0.0]), (7, [1.5, 1.0]), (7, [0.5, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_few_shards_are_asked_where_vectors_lie_in_groups(spark, monkeypatch):
    """After two passes most cells of grouped vectors cannot reach the k-th score."""
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(16)]
    rows = [(i, [m + rng.gauss(0, 0.02) for m in middles[i % 16]]) for i in range(3000)]
    sent = []
    plain = ball_tree._pass
    monkeypatch.setattr(ball_tree, "_pass", lambda vectors, queries, k: (sent.append(queries.count()), plain(vectors, queries, k))[1])
    assert run(spark, rows, every=10) == brute(rows, 10)
    assert sum(sent) < 300 * 16 / 2
