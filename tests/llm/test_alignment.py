import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import alignment as al
from quire.llm import textblocks as tb

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a_file, b_file = al.tokenizer_files()
    a = Tokenizer.from_file(a_file)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_file)
    table = {}
    for byte in range(256):  # the byte-level alphabet, from its definition
        table[chr(byte) if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174 else chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174) for x in range(byte)))] = byte
    return a, b, table


def brute(rows, encoders):
    a, b, table = encoders
    docs, held = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            own = (" " + text).encode()
            left = a.encode(" " + text, add_special_tokens=False)
            at = [(i, bytes(table[c] for c in t)) for i, t in zip(left.ids, left.tokens, strict=True)]
            bt = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(x for _, x in at) == own == b"".join(x for _, x in bt):
                i = j = 0
                p = q = 0
                group = ([], [])
                while i < len(at) or j < len(bt):
                    if p <= q and i < len(at):
                        group[0].append(at[i][0])
                        p += len(at[i][1])
                        i += 1
                    else:
                        group[1].append(bt[j][0])
                        q += len(bt[j][1])
                        j += 1
                    if p == q and group[0] and group[1]:
                        groups.append(group)
                        group = ([], [])
        linked = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(linked.keys())
        docs.append((doc, groups, linked))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc, groups, linked in docs:
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(linked.values()),
            sum(k for pair, k in linked.items() if held[pair] == best[pair[0]]), sum(k * held[pair] for pair, k in linked.items()),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    odd = ["naïve", "東京", "🙂", "don't", "x=1;", "12345", "<|endoftext|>", "<s>", "<0x41>", "　", "\xa0", "\t", "\x00", "é" * 3, "ﬁ", "aaaaaaaaaaaaaaaaaaaaaaaa", "=" * 70, "İ", "​", "\r"]
    plain = ["the", "of", "internationalization", "Word", "tokens", "aligned", "unhappiness", "reads"]
    rows = []
    for i in range(150):
        words = [rng.choice(odd if rng.random() < 0.2 else plain) for _ in range(rng.randint(1, 60))]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\n\n", " \n", "", "\t "]) for w in words)))
    rows += [(900, None), (901, ""), (902, " "), (903, "\n"), (904, "has ▁ in it"), (905, "   lead"), (906, "trail  "), (907, "\nline"), (908, "a"), (909, "x" * 5000), (910, "ha " * 2000)]
    return rows + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (911, rows[8][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 1, 2) for i, t in rows], "doc_id long, text string, pairs int, row int, n_a int")


def test_rows_equal_brute_force(spark, monkeypatch, encoders):
    rows = corpus()
    want = brute(rows, encoders)
    assert sum(w[1] > 0 for w in want) > 150
    got = al.alignments(frame(spark, rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    monkeypatch.setattr(al, "FREQUENT", 20)  # most links meet their counts in the join
    assert sorted(map(tuple, al.alignments(frame(spark, rows)).collect()), key=str) == want


def test_whole_table_equals_brute_force(spark, encoders):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, al.alignments(docs).collect()), key=str) == brute(rows, encoders)


def test_stretches_do_not_change_tokens(monkeypatch, encoders):
    """Encoded by stretches, in runs and one by one, and after the stretches seen were forgotten."""
    a, b, _ = encoders
    both = al.Tokenizers(*al.tokenizer_files())
    assert both.splits
    for limit in (10**6, 5):
        monkeypatch.setattr(al, "CACHE_STRETCHES", limit)
        for _, text in corpus():
            if text:
                a_ids, b_ids, _, _ = both.tokens(both.numbers(both.stretches(text)))
                assert a_ids.tolist() == a.encode(" " + text, add_special_tokens=False).ids
                assert b_ids.tolist() == b.encode(text)


def test_long_texts_in_pieces(monkeypatch, encoders):
    """A text of several pieces gives what it gives in one."""
    both = al._load(*al.tokenizer_files())
    text = "\n".join(t for _, t in corpus() if t and "▁" not in t)
    counts, groups, (doc, pairs, times) = al._documents([both.stretches(text)], both)
    monkeypatch.setattr(tb, "SLICE_BYTES", 3000)
    sums, digest, pieces, k = al._long(text, both)
    assert sums.tolist() == [int(c[0]) for c in counts.values()] and digest == hashlib.sha256(groups[0]).hexdigest()
    assert dict(zip(pieces.tolist(), k.tolist(), strict=True)) == dict(zip(pairs.tolist(), times.tolist(), strict=True))
    assert al._long(text + " ▁", both)[0].tolist() == [0, 0, 0, 0]


def test_links_of_large_groups(monkeypatch):
    """Blocks, repeated ids and groups of many tokens on both sides."""
    monkeypatch.setattr(al, "BLOCK_LINKS", 50)
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 280)
    a_end, b_end = np.array([5, 6, 120, 300]), np.array([1, 40, 41, 280])
    groups = al.Aligned(np.array([0, 1, 1, 4]), a_end, b_end)
    want = Counter()
    for g, (x, y) in enumerate(zip(np.split(a, a_end[:-1]), np.split(b, b_end[:-1]), strict=True)):
        want.update(((0, 2, 2, 2)[g], int(i) << al._SIDE_BITS | int(j)) for i in x for j in y)
    doc, pair, times = al.links(groups, a, b)
    assert {(int(d), int(p)): int(k) for d, p, k in zip(doc, pair, times, strict=True)} == want and len(doc) == len(want)


def test_empty_table(spark):
    assert al.alignments(frame(spark, [])).collect() == []
