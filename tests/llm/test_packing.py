import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from quire.llm import packing


def reference_cost(at, cost, window):
    """Least cost of a chain from 0 that ends less than a window before the last cut, over all chains."""
    points, prices = [0, *at], [0, *cost]
    best = [0] + [None] * len(at)
    for j in range(1, len(points)):
        steps = [best[i] + window - (points[j] - points[i]) + prices[j] for i in range(j) if best[i] is not None and points[j] - points[i] <= window]
        best[j] = min(steps, default=None)
    return min(b for p, b in zip(points, best, strict=True) if b is not None and points[-1] - p < window)


def test_monotone_queue_finds_the_cheapest_chain():
    rng = random.Random(2)
    for _ in range(200):
        at = sorted(rng.sample(range(1, 400), rng.randint(30, 120)))
        at = sorted({*at, *range(20, 400, 20)})
        cost = [rng.choice([0, 2, 8]) for _ in at]
        cuts = packing.best_cuts(at, cost, 40)
        prices = dict(zip(at, cost, strict=True))
        steps = np.diff([0, *cuts])
        assert (steps <= 40).all()
        assert sum(40 - s for s in steps) + sum(prices[c] for c in cuts) == reference_cost(at, cost, 40)


def texts():
    rng = random.Random(4)
    odd = ["", None, " \n ", "I'm, we'll don't's 'S x1234 é É İ ſ ß", "<|endoftext|> a<|startoftext|>b", "漢字かな　混じり。 é ́x\xa0y z", "a\x0bb\x0cc\x1cd\x85e\xadf", "🎉🎉 ٣٤ Ⅷ ²³ ǅ"]
    rows = [(i, t) for i, t in enumerate(odd)]
    for i in range(60):
        words = rng.choices(["The", "of", "stop.", "Über", "a,b", "x" * 30, "42", "??", "naïve!"], k=rng.choice([1, 5, 300, 3000]))
        rows.append((100 + i, rng.choice([" ", "\n"]).join(words)))
    rows += [(500, "word " * 30000), (501, "x"), (501, "x")]
    return rows


def test_every_id_once_and_little_padding(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "s", 3) for i, t in rows], "doc_id long, text string, source string, start int").coalesce(2)
    pieces = packing.pack(df).collect()
    encode = Tokenizer.from_file(packing.tokenizer_file())
    want = {}
    for i, t in rows:
        want[i] = encode.encode(t or "", add_special_tokens=False).ids + [2]
    have, sequences = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) > 0 and p.doc_tokens == len(want[p.doc_id])
        assert p.ids == want[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        have.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, spans in have.items():
        copies = sum(1 for j, _ in rows if j == i)
        assert sum(n for _, n in spans) == copies * len(want[i])
    assert set(have) == set(want)
    padding = total = 0
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.02 * total + 2 * 4096


def test_many_partitions_need_no_more_padding(spark):
    rows = [(i, "word " * (20 + 7 * i) + "end.") for i in range(120)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(60, "doc_id")).collect()
    lengths = {}
    for p in pieces:
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    assert sum(lengths.values()) == sum(n for _, n in {(p.doc_id, p.doc_tokens) for p in pieces})
    assert len({p.sequence_id >> 32 for p in pieces}) > 30
    assert sum(0 if n & (n - 1) == 0 else 4096 - n for n in lengths.values()) == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stretches_do_not_change_the_cheapest_chain():
    rng = random.Random(8)
    ends = np.array([False, True, False])
    for trial in range(12):
        docs = [(i, np.array(rng.choices([0, 1, 2], weights=[40, rng.choice([1, 6]), 0], k=rng.choice([1, 3, 30, 200])) + [2], dtype="<u4")) for i in range(300)]
        packer = packing.Packer(0, ends, 128, stretch=512, horizon=1 << 30)
        at, cost, n, early = [], [], 0, 0
        for i, ids in docs:
            packer.add(i, ids.tobytes())
            early = max(early, len(packer.rows))
            a, c = packing.cuts_of(ids, ends)
            at, cost, n = at + (a + n).tolist(), cost + c.tolist(), n + len(ids)
            assert packer.seen - packer.packed < 8000
        assert early > 100
        packer.close()
        sizes = {}
        for row in packer.rows:
            sizes[row[5]] = sizes.get(row[5], 0) + row[2]
        want = packing.best_cuts(at, cost, 128)
        assert np.cumsum([sizes[i] for i in sorted(sizes)])[: len(want)].tolist() == want
        assert packer.seen == packer.packed == n


def test_horizon_bounds_what_is_held():
    ends = np.zeros(3, bool)
    packer = packing.Packer(0, ends, 128, stretch=256, horizon=512)
    packer.chains.settled = lambda: []  # chains that never meet
    for i in range(400):
        packer.add(i, np.array([0] * (i % 97) + [2], dtype="<u4").tobytes())
        assert packer.seen - packer.packed < 512 + 256
    packer.close()
    sizes = {}
    for row in packer.rows:
        sizes[row[5]] = sizes.get(row[5], 0) + row[2]
    assert max(sizes.values()) <= 128 and sum(sizes.values()) == sum(i % 97 + 1 for i in range(400))


def test_caches_are_bounded_in_bytes(monkeypatch):
    encoder = packing.WordEncoder(packing.tokenizer_file())
    assert encoder.plain
    texts = ["漢字かな" * 5000, "X" * 9000, "ÀÉ" * 400 + "漢", "Ab" * 50 + " 漢 aB", "." * 300, "the hall"]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for bound in (96 << 20, 100_000, 1000, 0):
        monkeypatch.setattr(packing, "CACHE_BYTES", bound)
        for _ in range(2):
            assert encoder(texts) == want
            assert [encoder([t])[0] for t in texts] == want
            assert encoder.size == sum(4 * len(s) + len(ids) for s, ids in encoder.stretches.items()) <= bound
            assert bound or not encoder.pieces


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import normalizers

    other = Tokenizer.from_file(packing.tokenizer_file())
    other.normalizer = normalizers.NFC()
    other.save(str(tmp_path / "other.json"))
    encoder = packing.WordEncoder(str(tmp_path / "other.json"))
    assert not encoder.plain
    texts = ["The Hall of ÉCOLE", "", "a  b"]
    assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in other.encode_batch(texts, add_special_tokens=False)]
