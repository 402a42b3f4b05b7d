import hashlib
import random

import pytest

from quire.llm import chat_tree as ct
from quire.llm import skew

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int"


def brute(rows):
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append(((n is not None, n), (r or "").encode(), (t or "").encode()))
    out = []
    for c, turns in convs.items():
        turns = [(r.decode(), t.decode()) for _, r, t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def corpus():
    rng = random.Random(6)
    bits = ["[INST] ", " [/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>\n", "\\", "\\[", "[ROLE x]", "]", "hi", "é🎉", "\n", " ", "<|endoftext|>", "漢字"]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 6)))
    opening = [text() for _ in range(4)]
    rows = []
    for c in range(400):
        n = rng.choice([1, 2, 3, 4, 9])
        for t in range(n):
            role = rng.choice(["system", "user", "assistant", "tool]", "", None]) if t > 1 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, "same first" if t == 0 and c % 3 == 0 else rng.choice(opening) if t < 3 else text()))
    rows += [(900 + c, t, ("user", "assistant")[t], f"copy {t}") for c in range(120) for t in range(2)]
    rows += [(2000, t, "user", f"turn {t}") for t in range(300)]
    rows += [(None, 1, "user", None), (None, None, None, "x"), (3000, 1, "assistant", "a"), (3000, 1, "assistant", "a"), (3000, 1, "user", "b"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    return rows


@pytest.mark.parametrize("hot", [2_000, 5])
def test_read_back_equals_the_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rows = corpus()
    got = ct.digest(frame(spark, rows)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert ct.digest(frame(spark, [])).collect() == []


def test_shared_turns_once_with_positions_and_stretches(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "d"), (3, 0, "user", "a"), (3, 1, "assistant", "e")]
    trees, chains, members = ct.build(frame(spark, rows))
    nodes = sorted(trees.collect(), key=lambda r: r.seq)
    assert len(nodes) == 5 and members.count() == 3  # a, b, c, d, e once each
    by_start = {r.start: r for r in nodes}
    at = 0
    for r in nodes:
        assert r.start == at and r.length == len(r.ids)
        at += r.length
        spans = list(zip(r.ancestors[::2], r.ancestors[1::2]))
        assert sum(b - a for a, b in spans) == r.position
        up = [x for x in nodes if any(a <= x.start < b for a, b in spans)]
        assert [x.depth for x in up] == list(range(1, r.depth)) and all(x.start < r.start for x in up)
    assert by_start[0].position == 0


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choices("\\[]<>/ab \n", k=rng.randint(0, 20)))
        role = "".join(rng.choices("\\[]<x", k=3))
        opened, closed = ct.marks(role)
        assert ct.unescape(ct.escape(text)) == text
        assert ct.read_turns(opened + ct.escape(text) + closed) == [(role, text)]


def test_a_crowd_shares_its_first_turns_once(spark):
    rows = [(c, t, ("user", "assistant", "user")[t], ("first", "second", f"own {c % 250}")[t]) for c in range(500) for t in range(3)]
    trees, chains, members = ct.build(frame(spark, rows))
    nodes = trees.collect()
    assert len(nodes) == 252 and len({r.tree for r in nodes}) == 1 and members.count() == 500
    at = 0
    for r in sorted(nodes, key=lambda r: r.seq):
        assert r.start == at
        at += r.length
    shared = sum(r.length for r in nodes if r.depth < 3)
    assert all(r.position == shared and r.ancestors == [0, shared] for r in nodes if r.depth == 3)


def test_length_in_characters(spark):
    rows = [(1, 0, "user", "a[b"), (1, 1, "assistant", "é🎉"), (2, 0, "system", None), (2, 1, "x]", "")]
    got = {r.conv_id: r.formatted_chars for r in ct.digest(frame(spark, rows)).collect()}
    assert got == {1: len("[INST] a\\[b [/INST] é🎉</s>"), 2: len("<<SYS>><</SYS>>\n[ROLE x\\]][/ROLE]")}
