import random
import re
import zlib
from collections import Counter

from oracles import compare, connect

from quire.llm import queries, spelling

FOLDER = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
    met = {w: [x for x in words if x != w and near(w, x)] for w in words}
    best = {w: min(met[w], key=lambda x: (-words[x], x)) for w in words if met[w]}
    form = {w: best[w] if w in best and words[best[w]] >= 10 * words[w] else None for w in words}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n, len(met[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


def corpus():
    rng = random.Random(8)
    letters = "abÀÿe×"
    base = ["".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(12)] + ["aaaaaaaa", "bookkeeper", "Mississippi", "straßeño"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randint(1, 40)):
            w = base[min(int(rng.expovariate(0.4)), len(base) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "9", "\n", "ł"]).join(words)))
    rows += [(i + 1000, " ".join(["abcdefgh"] * 500 + ["abcdefgx"] * 30 + ["abcdefyx"] * 2)) for i in range(3)]  # a chain of forms
    return rows + [(None, rows[5][1]), (None, "abcdefgh"), (7, None), (8, ""), (9, "1234 -"), (7, rows[7][1]), (7, rows[7][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", 3) for i, t in rows], "doc_id long, text string, n int, word string, id int")


def test_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 50)
    monkeypatch.setattr(spelling, "BLOCK_KEYS", 70)
    rows = corpus()
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] and w[1] != w[2] for w in want)
    got = spelling.variants(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_very_long_words(spark):
    """Runs of thousands of letters: names grow with the letters, not with their square."""
    a = "acgt" * 1500
    b = a[:4000] + "t" + a[4001:]
    rows = [(i, f"{a} {b} {a}g {a} {b[1:]}") for i in range(40)]
    want = brute(rows)
    assert len(want) >= 4 and max(w[4] for w in want) >= 2
    assert sorted(map(tuple, spelling.variants(frame(spark, rows)).collect()), key=str) == want
    own, places = spelling.keys("ab" * 500_000)
    assert len({wild for wild, _, _ in places}) == 1_000_000


def test_empty_table(spark):
    assert spelling.variants(frame(spark, [])).collect() == []


def test_query_equals_its_oracle(spark):
    assert compare(spark, connect(FOLDER), FOLDER, queries.op12_spelling_variants, spelling.ORACLE_SQL) == ""
