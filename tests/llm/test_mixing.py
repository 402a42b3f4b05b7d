import hashlib
import math
import re

import duckdb
import pytest

from quire.llm import mixing


def brute(rows):
    """rows: (doc_id, text, source). Shares again and again until no target is above its cap."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {n: sum(z for z, r in zip(size, rows, strict=True) if r[2] == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[n] for n in capped)
        base = sum(weight[n] for n in names if n not in capped)
        target = {n: 3 * total[n] if n in capped else left * weight[n] / base for n in names}
        above = {n for n in names if n not in capped and target[n] > 3 * total[n]}
        if not above:
            break
        capped |= above
    out = []
    for n in names:
        quota = min(math.floor(target[n] + 0.5), 3 * total[n])
        epochs = quota // total[n] if total[n] else 0
        rest = quota - epochs * total[n]
        mine = []
        for (i, t, s), z in zip(rows, size, strict=True):
            if s == n:
                u = (int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                w = max(0.1, 1 - len(re.findall(r"[#*$%&|<>!]", t or "")) / z) if z else 1.0
                mine.append((-math.log(u) / w, -1 if i is None else i, z, i))
        for _, _, z, i in sorted(mine):
            part = max(0, min(z, rest))
            rest -= part
            out.append((i, z, total[n], round(target[n], 6), epochs * z + part))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect()), key=str)


@pytest.mark.parametrize("case", ["hot", "nulls", "single"])
def test_against_brute_force(spark, case):
    text = lambda i: ("word " * (i * 7 % 90) + "## " * (i % 5 == 0) * 4).strip()
    if case == "hot":
        rows = [(i, text(i), "é" if i % 3 == 0 else f"s{i % 11}") for i in range(600)]
    elif case == "nulls":
        rows = [(i, text(i), None if i % 2 else "a") for i in range(90)] + [(500, None, "b"), (501, "", "c"), (None, "one two", "a"), (7, text(7), "a"), (7, text(7), "a")]
    else:
        rows = [(i, text(i), "only") for i in range(50)]
    df = spark.createDataFrame([(i, t, s, 1, 2.0) for i, t, s in rows], "doc_id long, text string, source string, size int, key double")
    assert result(df) == brute(rows)
    assert result(df.repartition(5)) == brute(rows)


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert result(df.limit(0)) == []
    assert [r[1:] for r in result(df)] == [(0, 0, 0.0, 0)] * 2


def test_oracle(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(((a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(mixing.ORACLE_SQL).fetchall()), key=str)
    assert result(spark.read.parquet(path)) == want
