import random
import re

import numpy as np

from quire.llm import dart_minhash as dm


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, t, shingle_set(t)) for i, t in rows]
    for n, (i, t, s) in enumerate(sets):
        for j, u, r in sets[:n]:
            same = t is not None and t == u
            if same or (s and r and len(s & r) >= 0.8 * len(s | r)):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in rows}


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "the", "of"]
    rows = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([3, 8, 30, 120, 300]))
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows) + 1, rng.choice([" ", "\n"]).join(words)))
    base = rng.choices(vocab, k=150)  # one large group in which many pairs lie near the limit
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(150)] = rng.choice(vocab)
        rows.append((len(rows) + 1, " ".join(words)))
    return rows + [(9001, None), (9002, None), (9003, ""), (9004, ""), (9005, " "), (9006, rows[3][1]), (9007, "one two"), (9008, "one  two")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n int, root string")


def test_classes_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in dm.near_classes(frame(spark, rows)).collect()}
    assert got == want
    monkeypatch.setattr(dm, "BLOCK_SHINGLES", 3000)  # the large group is compared in several blocks
    got = {r.doc_id: r.class_id for r in dm.near_classes(frame(spark, rows)).collect()}
    assert got == want


def test_empty_table_and_repeated_rows(spark):
    assert dm.near_classes(frame(spark, [])).collect() == []
    text = " ".join(f"t{i}" for i in range(50))
    got = dm.near_classes(frame(spark, [(2, text), (2, text), (5, text)])).collect()
    assert sorted(map(tuple, got)) == [(2, 2), (2, 2), (5, 2)]


def test_coordinates_agree_as_the_weighted_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 60).astype(np.uint64)
    a = np.concatenate([common, common[:20], rng.integers(0, 2**63, 20).astype(np.uint64)])
    b = np.concatenate([common, rng.integers(0, 2**63, 30).astype(np.uint64)])
    both = np.concatenate([a, b])
    first = np.array([0, len(a), len(a) + len(b)])
    for weights, want in (("set", 60 / 110), ("count", 60 / 130)):
        s = dm.signatures(both, first, 4000, weights)
        assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_texts_under_one_id_and_null_ids(spark):
    a = " ".join(f"t{i}" for i in range(60))
    near = a.replace("t7 ", "other ")
    b = " ".join(f"u{i}" for i in range(60))
    rows = [(2, a), (2, b), (3, near), (4, b), (2, None), (None, b + " end"), (9, a)]
    got = sorted(map(tuple, dm.near_classes(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(2, 2), (2, None), (3, 2), (4, None), (2, 2), (None, None), (9, 2)], key=str)


def test_representatives_keep_rows_as_rows(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "tu")
    schema = "_first int, doc_id long, text string, print string, node long, class_id long"
    rows = [(1, 2, a, "p", 5, 6), (2, 2, b, "q", 5, 6), (3, 3, a, "p", 5, 6), (4, 4, b, "p", 5, 6), (5, None, a, "p", 5, 6), (6, 7, None, "p", 5, 6), (7, 7, None, "p", 5, 6), (8, 9, "x", "p", 1, 1), (8, 9, "x", "p", 1, 1), (9, 9, "x", "p", 1, 1)]
    got = dm.representatives(spark.createDataFrame(rows, schema))
    assert got.columns == ["_first", "doc_id", "text", "print", "node", "class_id"]
    assert sorted(r[0] for r in got.collect()) == [1, 2, 5, 6, 7, 8]


def test_stars_alone_do_not_decide(spark):
    """Two documents that are alike, but not like the lead of the bucket they share, still meet."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base))]
    for i in range(2, 60):
        words = list(base)
        for _ in range(14):
            words[rng.randrange(400)] = f"x{i}"
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words[:-1], "y"]))]
    got = {r.doc_id: r.class_id for r in dm.near_classes(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_recall_of_planted_copies_above_the_limit(spark):
    """Every planted pair at 0.8 or more is found; the share is stated in the README."""
    rng = random.Random(12)
    rows, pairs = [], []
    for i in range(150):
        words = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(rng.randint(60, 300))]
        other = list(words)
        for _ in range(rng.randint(0, max(1, len(words) // 50))):
            other[rng.randrange(len(other))] = "edit"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * i, 2 * i + 1))
    got = {r.doc_id: r.class_id for r in dm.near_classes(frame(spark, rows)).collect()}
    assert len(pairs) > 100 and all(got[a] == got[b] for a, b in pairs)


def template(n, seed=1):
    """Pages of one template: seven shingles of ten are shared, so bands are, but no two are alike."""
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 2**63, 140).astype(np.uint64)
    sets = [np.concatenate([shared, rng.integers(0, 2**63, 60).astype(np.uint64)]) for _ in range(n)]
    return np.concatenate(sets), np.arange(n + 1) * 200


def test_pages_of_one_template_do_not_meet():
    """What is compared grows with the pages, not with their square; those alike are found among them."""
    seen = {}
    for n in (500, 1000, 4000):
        elements, first = template(n)
        elements = elements.copy()
        elements[200:400] = elements[:200]  # the second page is nearly the first
        elements[200:220] = np.arange(20)
        doc = np.repeat(np.arange(n), 200)
        name, inverse = np.unique(elements, return_inverse=True)
        pairs = sum(len(x) for x, _ in dm.candidates(doc, inverse, np.bincount(inverse), np.arange(n), 0.8))
        seen[n] = pairs
        got = dm.joined_pairs(np.arange(n) + 7, np.arange(n), elements, first, 0.8, "set")
        assert got == [(7, 8)]
    assert seen[4000] <= seen[500] * 8**1.2


def test_candidates_hold_every_pair(monkeypatch):
    """Against all pairs, for sets of many sizes around the limit and several similarities."""
    rng = np.random.default_rng(3)
    for limit in (10**6, 20):
        monkeypatch.setattr(dm, "BLOCK_PAIRS", limit)
        for similarity in (0.5, 0.8, 0.9, 1.0):
            sets = []
            for _ in range(60):
                base = rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)
                sets += [np.unique(np.where(rng.random(len(base)) < 0.08, rng.integers(0, 60, len(base)).astype(np.uint64), base)) for _ in range(3)]
            label = rng.integers(0, 100, len(sets))
            doc, name = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets).astype(np.int64)
            found = {(int(x), int(y)) for a, b in dm.candidates(doc, name, np.bincount(name), label, similarity) for x, y in zip(a, b, strict=True)}
            for i in range(len(sets)):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if label[i] != label[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                        assert (j, i) in found
