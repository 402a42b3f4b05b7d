import random
import re
from collections import Counter

import numpy as np

from quire.llm import ngram_quality

SCHEMA = "doc_id long, text string, kept string, n_words int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_base_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a\n\na\n a\na", "x " * 9, "x " * 40, "é🎉 #|<>\x0bq\x0c\xa0z", "go on " * 30]
    for _ in range(60):
        lines = [" ".join(rng.choices(["a", "bb", "é", "#x", "the"], k=rng.randint(0, 25))) for _ in range(rng.randint(1, 12))]
        texts.append("\n".join(rng.choices(lines, k=rng.randint(1, 15))))
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ngram_quality.assess(docs, labels).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert r.kept == (not r.base_failed)
    assert ngram_quality.assess(docs.limit(0), labels).collect() == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = ngram_quality.assess(docs, train).join(test, "doc_id").select("probability", "quality", "base_failed", "kept").collect()
    right = sum((r.probability >= 0.5) == (r.quality == 1) for r in got)
    assert right >= 0.98 * len(got)
    assert all(not r.kept for r in got if r.base_failed)
    # calibrated: among texts given p, about that share is good
    low = [r.quality for r in got if r.probability < 0.5]
    assert sum(low) <= 0.1 * len(low)


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    runs = [{r.doc_id: r.probability for r in ngram_quality.assess(d, labels).collect()} for d in (docs, docs.repartition(7, "text"))]
    assert runs[0] == runs[1] and len(runs[0]) == docs.count()


def test_a_long_text_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "good words here " * 200_000, "k", 0), (1, None, "k", 0), (1, None, "k", 0)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.n_words, r.kept) for r in ngram_quality.assess(docs, labels).collect())
    assert got == [(0, False), (0, False), (600_000, False)]


def test_few_labels_are_labels(spark):
    """No number of labels switches the classifier off, but a missing kind does."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    bad, good = (labels.where(f"quality = {k}").orderBy("doc_id") for k in (0, 1))
    for n in (1, 4, 6):
        got = ngram_quality.assess(docs, bad.limit(n).unionByName(good.limit(n))).where("not base_failed")
        assert 0 < got.where("not kept").count() < got.count()
    assert ngram_quality.assess(docs, good.limit(6)).where("not base_failed and not kept").count() == 0


def test_entries_are_bounded_by_a_sample(monkeypatch):
    rng = np.random.default_rng(1)
    row = np.repeat([0, 1, 3], [5000, 40, 3000])
    index = np.concatenate([rng.permutation(9000)[:n] for n in (5000, 40, 3000)]).astype(np.int32)
    value = rng.random(len(row)).astype(np.float32)
    monkeypatch.setattr(ngram_quality, "MOST_ENTRIES", 1000)
    r, i, v = ngram_quality._bounded(row, index, value)
    assert np.bincount(r).tolist() == [1000, 40, 0, 1000] and set(zip(r.tolist(), i.tolist())) <= set(zip(row.tolist(), index.tolist()))
    assert all((np.diff(i[r == k]) > 0).all() for k in (0, 1, 3))
    assert np.allclose(v[r == 1], value[row == 1][np.argsort(index[row == 1])])
    assert abs(v[r == 0].sum() / value[row == 0].sum() - 1) < 0.1  # the kept ones stand for the others
