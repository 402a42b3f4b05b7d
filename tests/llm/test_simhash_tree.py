import random
import re

import numpy as np
import xxhash

from quire.llm import simhash_tree as st


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    votes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in votes) > len(votes))


def brute(rows):
    prints = [print_of(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(200)] + ["É", "The", "x y"]
    rows = []
    for _ in range(30):
        base = rng.choices(vocab, k=rng.choice([1, 2, 3, 20, 400]))
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows) + 1, rng.choice([" ", "\n\t", "  "]).join(words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (3, rows[9][1]), (None, rows[9][1]), (None, "alone of its kind here"), (950, rows[4][1].upper()), (951, " ".join(vocab * 3000))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 1, 2) for i, t in rows], "doc_id long, text string, print int, id int, root int")


def test_rows_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    for rows_a_shard in (4096, 16):  # one shard, and many with guests
        monkeypatch.setattr(st, "SHARD_ROWS", rows_a_shard)
        got = st.near_components(frame(spark, rows))
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_table(spark):
    assert st.near_components(frame(spark, [])).collect() == []


def test_links_of_many_points_equal_brute_force(spark, monkeypatch):
    """Random points, a dense ball and chains, by the tree in one task and over shards."""
    rng = np.random.default_rng(4)
    points = [int(x) for x in rng.integers(0, 2**64, 3000, dtype=np.uint64)]
    flip = lambda x, k: x ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    points += [flip(points[0], int(rng.integers(1, 7))) for _ in range(1500)]
    for x in points[1:200]:
        for _ in range(4):
            points.append(x := flip(x, 2))
    points = np.unique(np.array(points, dtype=np.uint64))
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    want = set(zip(*(x.tolist() for x in st.forest(points[a], points[b])), strict=True))
    assert len(want) > 1000
    shuffled = rng.permutation(points)
    assert set(zip(*(x.tolist() for x in st.linked(shuffled, np.ones(len(points), bool))), strict=True)) == want
    monkeypatch.setattr(st, "SHARD_ROWS", 100)
    got = np.array(st.links(spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "print long")).collect(), dtype=np.int64).view(np.uint64)
    assert set(zip(*(x.tolist() for x in st.forest(got[:, 0], got[:, 1])), strict=True)) == want
    assert len(got) < 4 * len(points)  # a forest a shard, not all pairs of the ball


def test_every_point_has_one_home_and_linked_points_meet():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    near = points[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    both = np.concatenate([points, near])
    tree = st.Tree(points[::4], 64)
    homes, seen = np.zeros(len(both), int), [set() for _ in both]
    for leaf, at, home in tree.route(both):
        homes[at[home]] += 1
        for i, own in zip(at.tolist(), home.tolist(), strict=True):
            seen[i].add((leaf, own))
    assert tree.leaves > 30 and (homes == 1).all()
    for i in range(500):
        j = len(points) + i
        met = [1 for leaf in {x for x, _ in seen[i]} & {x for x, _ in seen[j]} if (leaf, True) in seen[i] or (leaf, True) in seen[j]]
        assert len(met) == 1
