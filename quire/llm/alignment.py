"""Alignment of two tokenizers' tokens over whole documents.

A encodes a space and the text with a byte-level vocabulary, B the text with a
piece vocabulary that adds the space itself. Both give tokens whose bytes, joined,
are the space and the text; the byte offsets at which tokens of both end cut the
tokens into groups, and every A token is linked with every B token of its group.

A whole slice of an Arrow batch is one byte string: token lengths are summed up
over it, the ends of A and of B are counted per byte in one ``bincount`` each, and
groups are cut where both counts are positive. A document's last byte always is
such a place, so no group crosses documents, and prefix sums at the documents'
offsets give each its tokens, groups and links. Links of equal id pairs are summed
per document, so a group of many equal tokens costs no more than its distinct ids.

Texts are encoded by stretches: both vocabularies are cut before a space or a line
end that stands between two characters which are no white space, where neither
ever has a token across (that is checked on B's pieces when it is loaded; A's
splitting pattern ensures it). Frequent stretches are encoded once per task.

A pair's count is the number of documents that hold it linked. Counts are summed
before they are shuffled. The ``FREQUENT`` pairs of the highest counts are
broadcast, which settles most links where they are; the links of other pairs are
joined with their counts, none of which has more than a small part of the rows.
The highest count of each A id is a table of at most as many rows as A has ids.

Defined results: a null or empty text, and one in which A's or B's bytes differ
from space and text, has zeros and an empty ``groups_sha256``; special tokens'
strings are plain text; rows that share a doc_id, and repeated rows, are documents
each of its own; a null doc_id stays null; an empty table gives no rows. A very
long text is aligned in pieces of about ``tb.SLICE_BYTES``, cut where stretches
are. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textblocks as tb
from quire.llm.recovery import checkpointed

FREQUENT = 1 << 16
CACHE_STRETCHES = 500_000
CACHE_IDS = 1 << 22
RUN_STRETCHES = 256
SMALL_GROUP = 16
BLOCK_LINKS = 1 << 20
_SIDE_BITS = 20
_STRETCH = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: The bytes that a byte-level vocabulary writes as themselves; the others are written from U+0100 on, in order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SCHEMA = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both vocabularies, and what they make of the stretches seen so far: stretch i has the ids ``first[i]:first[i + 1]`` of each side."""

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte_of = dict(zip(map(chr, _PLAIN), _PLAIN, strict=True))
        byte_of |= {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.splits = not any("\n" in p or "▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i))
        self.a_width, self.b_width = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        numbers = [b"%d" % i for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits = np.array([list(t.ljust(8)) for t in numbers], dtype=np.uint8)
        self.width = np.array([len(t) for t in numbers])
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.a_ids, self.b_ids = array("i"), array("i")
        self.a_first, self.b_first = array("q", [0]), array("q", [0])
        self.same = bytearray()

    def stretches(self, text: str) -> list[str]:
        """The parts of a space and the text that are encoded by themselves."""
        return _STRETCH.split(" " + text) if self.splits else [" " + text]

    def _encoded(self, part: str) -> tuple[list[int], list[int], bool]:
        a = self.a.encode(part, add_special_tokens=False).ids
        # B puts a space before what it gets, which is the stretch's own or, before a line end, goes
        b = self.b.encode(part[1:], num_threads=1) if part[0] == " " else self.b.encode(part, num_threads=1)[1:]
        own = part.encode()
        same = b"".join([self.a_bytes[i] for i in a]) == own == b"".join([self.b_bytes[i] for i in b])
        return a, b, same

    def _keep(self, part: str, a, b, same: bool) -> None:
        self.slot[part] = len(self.same)
        self.a_ids.extend(a)
        self.b_ids.extend(b)
        self.a_first.append(len(self.a_ids))
        self.b_first.append(len(self.b_ids))
        self.same.append(same)

    def _keep_run(self, parts: list[str]) -> None:
        """Stretches that follow one another as one text; cut again where they end."""
        a, b, same = self._encoded("".join(parts))
        ends = np.cumsum([len(part.encode()) for part in parts])
        a_upto, b_upto = (np.concatenate([[0], np.cumsum(width[ids])]) for width, ids in ((self.a_width, a), (self.b_width, b)))
        a_cut, b_cut = np.searchsorted(a_upto, ends), np.searchsorted(b_upto, ends)
        if same and (a_upto[a_cut] == ends).all() and (b_upto[b_cut] == ends).all():
            x = y = 0
            for part, p, q in zip(parts, a_cut.tolist(), b_cut.tolist(), strict=True):
                self._keep(part, a[x:p], b[y:q], True)
                x, y = p, q
        else:
            for part in parts:
                self._keep(part, *self._encoded(part))

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of stretches. Numbers given before no longer hold."""
        if len(self.slot) > CACHE_STRETCHES or len(self.a_ids) > CACHE_IDS:
            self._forget()
        slot = self.slot
        fresh = [part for part in dict.fromkeys(parts) if part not in slot]
        follows = [part for part in fresh if self.splits and len(part) > 1 and not part[1].isspace() and not part[-1].isspace()]
        for k in range(0, len(follows), RUN_STRETCHES):
            self._keep_run(follows[k : k + RUN_STRETCHES])
        for part in fresh:
            if part not in slot:
                self._keep(part, *self._encoded(part))
        return np.fromiter(map(slot.__getitem__, parts), np.int64, len(parts))

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of the stretches one after another, and how many each stretch has."""
        out = []
        for ids, first in ((self.a_ids, self.a_first), (self.b_ids, self.b_first)):
            ids, first = np.frombuffer(ids, np.int32), np.frombuffer(first, np.int64)
            n = first[numbers + 1] - first[numbers]
            at = np.repeat(first[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out += [ids[at].astype(np.int64), n]
        return out[0], out[2], out[1], out[3]

    def agree(self, numbers: np.ndarray) -> np.ndarray:
        """Which stretches both sides give back byte by byte."""
        return np.frombuffer(self.same, np.uint8)[numbers].astype(bool)


@functools.lru_cache(maxsize=1)
def _load(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


@dataclass
class Aligned:
    """Groups of consecutive documents. Groups ``first[d]:first[d + 1]`` are those of document d; ``a_end`` and ``b_end`` say up to which token a group goes."""

    first: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.a_end, prepend=0), np.diff(self.b_end, prepend=0)


def align(a_lengths: np.ndarray, b_lengths: np.ndarray, offsets: np.ndarray) -> Aligned:
    """Groups of the documents whose bytes lie at ``offsets`` in one string, from the byte lengths of all A and B tokens in order."""
    size = int(offsets[-1])
    a_ends = np.bincount(np.cumsum(a_lengths), minlength=size + 1)
    b_ends = np.bincount(np.cumsum(b_lengths), minlength=size + 1)
    cuts = np.flatnonzero((a_ends > 0) & (b_ends > 0))
    return Aligned(np.searchsorted(cuts, offsets, side="right"), np.cumsum(a_ends)[cuts], np.cumsum(b_ends)[cuts])


def written(groups: Aligned, a: np.ndarray, b: np.ndarray, digits: np.ndarray, width: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document."""
    a_size, b_size = groups.sizes()
    n = len(a) + len(b)
    ids = np.empty(n, dtype=np.int64)
    ids[np.arange(len(a)) + np.repeat(groups.b_end - b_size, a_size)] = a
    ids[np.arange(len(b)) + np.repeat(groups.a_end, b_size)] = b
    mark = np.full(n, ord(","), dtype=np.uint8)
    last = groups.a_end + groups.b_end
    mark[last - b_size - 1] = ord("|")
    mark[last - 1] = ord(";")
    length = width[ids] + 1
    stop = np.cumsum(length)
    out = np.empty(int(stop[-1]) if n else 0, dtype=np.uint8)
    start = stop - length
    for k in range(int(length.max()) - 1 if n else 0):
        some = np.flatnonzero(length > k + 1)
        out[start[some] + k] = digits[ids[some], k]
    out[stop - 1] = mark
    out = out.tobytes()
    ends = np.concatenate([[0], last])[groups.first]
    at = np.concatenate([[0], stop])[ends].tolist()
    return [out[x : y - 1] if y > x else b"" for x, y in zip(at[:-1], at[1:], strict=True)]


def _summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times of equal (doc, pair), both in order; a pair has up to twice ``_SIDE_BITS`` bits."""
    if not len(doc):
        return doc, pair, times
    key = (doc << 2 * _SIDE_BITS) | pair
    if (times == 1).all():
        key.sort()
    else:
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new] >> 2 * _SIDE_BITS, key[new] & ((1 << 2 * _SIDE_BITS) - 1), np.add.reduceat(times, new)


def links(groups: Aligned, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair, links) of each pair that a document holds linked."""
    a_size, b_size = groups.sizes()
    doc = np.repeat(np.arange(len(groups.first) - 1), np.diff(groups.first))
    group = np.arange(len(a_size))
    sides = []
    for ids, size in ((a, a_size), (b, b_size)):
        side = np.repeat(group, size), ids, np.ones(len(ids), dtype=np.int64)
        # in large groups, equal ids of one side are one entry with a number of times
        sides.append(_summed(*side) if (size > SMALL_GROUP).any() else side)
    (ag, ai, ak), (bg, bi, bk) = sides
    b_first, b_count = np.searchsorted(bg, group), np.bincount(bg, minlength=len(group))
    found, held, at = [], 0, 0
    each = b_count[ag]
    upto = np.cumsum(each)
    while at < len(ag):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_LINKS, side="right")))
        n = each[at:stop]
        left = np.repeat(np.arange(at, stop), n)
        right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + b_first[ag[left]]
        found.append(_summed(doc[ag[left]], (ai[left] << _SIDE_BITS) | bi[right], ak[left] * bk[right]))
        held += len(found[-1][0])
        if len(found) > 1 and held > 4 * BLOCK_LINKS:
            found = [_summed(*map(np.concatenate, zip(*found, strict=True)))]
            held = len(found[0][0])
        at = stop
    if not found:
        return tuple(np.zeros((3, 0), dtype=np.int64))
    return found[0] if len(found) == 1 else _summed(*map(np.concatenate, zip(*found, strict=True)))


def _between(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``first``, by prefix sums."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def _documents(parts: list[list[str]], both: Tokenizers) -> tuple[dict[str, np.ndarray], list[bytes], tuple]:
    """Counts, written groups and links of documents given as stretches; those with differing bytes have none."""
    numbers = both.numbers([part for document in parts for part in document])
    first = np.concatenate([[0], np.cumsum([len(document) for document in parts], dtype=np.int64)])
    whole = _between(~both.agree(numbers), first) == 0
    numbers = numbers[np.repeat(whole, np.diff(first))]
    first = np.concatenate([[0], np.cumsum(np.diff(first) * whole)])
    a, b, a_each, b_each = both.tokens(numbers)
    n_a, n_b = _between(a_each, first), _between(b_each, first)
    a_lengths = both.a_width[a]
    offsets = np.concatenate([[0], np.cumsum(_between(a_lengths, np.concatenate([[0], np.cumsum(n_a)])))])
    groups = align(a_lengths, both.b_width[b], offsets)
    a_size, b_size = groups.sizes()
    counts = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups.first), "n_links": _between(a_size * b_size, groups.first)}
    return counts, written(groups, a, b, both.digits, both.width), links(groups, a, b)


def _pieces(parts: list[str]):
    """Stretches of a long text in runs of about a slice."""
    at, size = 0, 0
    for k, part in enumerate(parts):
        size += len(part)
        if size > tb.SLICE_BYTES // 2:
            yield parts[at : k + 1]
            at, size = k + 1, 0
    if at < len(parts):
        yield parts[at:]


def _long(text: str, both: Tokenizers) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
    """Counts, digest and links of a text of more than a slice, whose pieces are aligned one after another."""
    sums, seen, digest = np.zeros(4, dtype=np.int64), [], hashlib.sha256()
    for k, piece in enumerate(_pieces(both.stretches(text))):
        counts, texts, found = _documents([piece], both)
        if not counts["n_a"][0]:
            return np.zeros(4, dtype=np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums += [int(c[0]) for c in counts.values()]
        digest.update((b";" if k else b"") + texts[0])
        seen = [_summed(*map(np.concatenate, zip(*seen, found, strict=True)))]
    return sums, digest.hexdigest(), seen[0][1], seen[0][2]


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, pa.int64()))


def _aligned(a_file: str, b_file: str):
    def run(batches):
        both = _load(a_file, b_file)
        names = [field.split(" ")[0] for field in SCHEMA.split(", ")]
        for batch in batches:
            for part, _, offsets in tb.slices(batch, "text"):
                texts = part.column("text").to_pylist()
                if int(offsets[-1]) > tb.SLICE_BYTES:
                    sums, digest, pairs, times = _long(texts[0], both)
                    columns = [pa.array([int(x)], pa.int64()) for x in sums] + [pa.array([digest]), _lists(pairs, np.array([len(pairs)])), _lists(times, np.array([len(times)]))]
                else:
                    counts, groups, (doc, pairs, times) = _documents([both.stretches(t) if t else [] for t in texts], both)
                    each = np.bincount(doc, minlength=len(texts))
                    hashes = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                    columns = [pa.array(c, pa.int64()) for c in counts.values()] + [pa.array(hashes, pa.string()), _lists(pairs, each), _lists(times, each)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names)

    return run


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best) of (pair) rows, one for each document that holds the pair linked: best if no pair of its A id has a higher count."""
    counts = checkpointed(pairs.groupBy("pair").agg(F.count("*").alias("count")))
    # as many rows as A has ids, at most
    highest = counts.groupBy(F.shiftrightunsigned("pair", _SIDE_BITS).alias("a")).agg(F.max("count").alias("highest"))
    known = counts.withColumn("a", F.shiftrightunsigned("pair", _SIDE_BITS)).join(F.broadcast(highest), "a")
    return checkpointed(known.select("pair", "count", (F.col("count") == F.col("highest")).alias("best")))


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """One row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(texts.mapInArrow(_aligned(*(files or tokenizer_files())), SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(rows.select(F.explode("pairs").alias("pair")))
    frequent = checkpointed(counts.orderBy(F.col("count").desc(), "pair").limit(FREQUENT))
    held = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("held")).select("row", F.col("held.pairs").alias("pair"), F.col("held.times").alias("times"))
    sums = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    often = held.join(F.broadcast(frequent), "pair").groupBy("row").agg(*sums)
    seldom = held.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(counts, "pair").groupBy("row").agg(*sums)
    linked = often.unionByName(seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = rows.drop("pairs", "times").join(linked, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
