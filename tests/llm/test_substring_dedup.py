import hashlib
import random
import re

import pytest

from quire.llm import substring_dedup

SCHEMA = "doc_id long, text string, source string, id string, keys int"


def brute(rows, width=13):
    seen, docs = {}, []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        docs.append((i, words))
        for p in range(len(words) - width + 1):
            k = tuple(words[p : p + width])
            seen[k] = min(seen.get(k, i), i)
    out = []
    for i, words in docs:
        gone = set()
        for p in range(len(words) - width + 1):
            if seen[tuple(words[p : p + width])] < i:
                gone.update(range(p, p + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], SCHEMA)
    return sorted(tuple(r) for r in substring_dedup.digest(df).collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "the", "é", "x" * 40, "🎉", "of", "and"] + [f"w{i}" for i in range(60)]
    shared = [" ".join(rng.choices(vocab, k=n)) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choices(vocab, k=rng.randint(1, 40))))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(200 + i, "go " * n) for i, n in enumerate((5, 13, 14, 20, 40))]
    rows += [(300 + i, "ab cd " * n) for i, n in enumerate((6, 7, 8, 30))]
    rows += [(400, rows[7][1]), (401, rows[7][1]), (402, None), (403, ""), (404, " \n"), (405, shared[4] + "\xa0tail\x0bend")]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(20))
    assert [r[2] for r in run(spark, [(1, text), (1, text), (2, text)])] == [0, 0, 20]
    assert run(spark, []) == []


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in substring_dedup.digest(docs).collect()) == brute(rows)


def test_texts_under_one_id_do_not_mix(spark):
    a = " ".join(f"t{i}" for i in range(20))
    b = " ".join(f"u{i}" for i in range(20))
    c = " ".join(f"t{i}" for i in range(4, 18)) + " " + b
    rows = [(1, a), (2, a), (2, b), (2, None), (3, c), (3, a), (3, b), (4, c), (4, c), (5, b)]
    assert run(spark, rows) == brute(rows)
    rng = random.Random(11)
    pool = [" ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randint(10, 60))) for _ in range(20)]
    rows = [(rng.randrange(30), " ".join(rng.choices(pool, k=rng.randint(0, 3)))) for _ in range(200)]
    assert run(spark, rows) == brute(rows)


def test_a_null_id_comes_first_and_a_long_text_is_whole(spark):
    long = " ".join(f"x{i % 4001}" for i in range(300_000))  # a slice of its own
    tail = " ".join(long.split()[1000:1100])
    rows = [(None, tail), (7, long), (8, "new " + tail)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.digest(spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 100, 0), (7, 300_000, 75 * 100), (8, 101, 100)], key=str)


def test_width_is_checked(spark):
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA), width=64)


@pytest.mark.parametrize("keys", [4])
def test_few_remembered_keys(spark, monkeypatch, keys):
    monkeypatch.setattr(substring_dedup, "SEEN_KEYS", keys)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(90)], k=8)) + " " + passage) for i in range(90)]
    assert run(spark, rows) == brute(rows)
