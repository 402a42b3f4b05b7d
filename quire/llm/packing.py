"""Order-preserving packing into token windows by dynamic programming.

Documents keep their input order inside each partition. The cuts of a
partition's token stream are chosen among document ends, sentence ends and, in
long sentences, every ``STEP`` tokens. With f(j) the least cost of the stream up
to cut j, f(j) = min over i within one window of f(i) + padding(i, j) +
penalty(j); padding is window - (j - i), so f(i) + i is all that i contributes
and a monotone queue gives each minimum in constant amortised time. Only what is
in that queue can begin a later window, so a cut that the chains of all its
members share is settled: such cuts are emitted after every ``STRETCH`` tokens
and the program goes on with what is left, so the chain is the best one over the
whole partition while memory does not follow the partition. Where chains have
not met within ``HORIZON`` tokens, most of the cheapest one is taken as it is.
What remains at the end of a partition is split into powers of two down to one
token, which need no padding, so padding does not follow the number of partitions.

The fast way to token ids holds for one normaliser and pre-tokenizer, which are
compared with those of the file; any other file's tokenizer gets whole texts.

Defined results: a null or empty text is the end token alone; rows that share a
doc_id are separate documents; a text longer than a window is cut, preferably
between sentences. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textblocks as tb

WINDOW = 4096
END = 2
SENTENCE_CUT, WORD_CUT = 2, 8
STEP = 64
STRETCH = 64 * WINDOW
HORIZON = 4 * STRETCH
#: Bounds of the caches: entries, and the bytes of their keys (four a character at most) and ids; longer stretches than ``SHORT`` go first.
CACHE_ENTRIES, CACHE_BYTES, SHORT = 700_000, 192 << 20, 64
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, through bounded caches.

    The tokenizer never joins what white space separates, so stretches between
    spaces are cached; plain Latin ones are built from the tokenizer's own
    pre-tokens, others go to it as they are. Texts that hold one of its special
    strings go to it whole, and so does every text if the tokenizer is of another
    kind (``plain`` is false).
    """

    # The parts of the tokenizer's file that the fast way relies on.
    _normalizer = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    _split = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False}

    _piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    _exotic = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
    _stretch = re.compile(r"[^\t\n\r\x20]+")
    _marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which opens pieces of its own

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([t.replace("</w>", "")[-1:] in tuple(".!?") for t in tokens])
        self.stretches: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.size = 0
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.plain = self._known_kind()

    def _known_kind(self) -> bool:
        parts = json.loads(self.tokenizer.to_str())
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers") or []
        if parts["normalizer"] != self._normalizer or len(steps) != 2 or parts["truncation"] or parts["padding"]:
            return False
        split, letters = steps
        splits = split.get("type") == "Split" and split.get("pattern") == {"Regex": self._split} and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        by_bytes = letters.get("type") == "ByteLevel" and not letters.get("add_prefix_space") and not letters.get("use_regex")
        return splits and by_bytes and all(parts["model"].get(k) == v for k, v in self._model.items())

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _merge(self, piece: str) -> bytes:
        """One normalised pre-token straight through the tokenizer's model."""
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(shown)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, dtype="<u4").tobytes()

    def _learn(self, plain: list[str], other: list[str]) -> None:
        """``plain`` holds lower-case stretches without exotic characters; most are letters and marks after them."""
        pieces, known, merge, marks = self.pieces, self.stretches, self._merge, self._marks

        def of(piece: str) -> bytes:
            ids = pieces.get(piece)
            if ids is None:
                ids = merge(piece)
                if len(piece) <= SHORT:
                    pieces[piece] = ids
            return ids

        for s in plain:
            if s.isalpha():
                known[s] = of(s)
                continue
            core = s.rstrip(marks)
            known[s] = of(core) + of(s[len(core) :]) if core.isalpha() and len(core) < len(s) else b"".join(map(of, self._piece.findall(s)))
        known.update(zip(other, self._encode(other), strict=True))

    def _bounded(self, used: tuple[set[str], ...], new: list[str]) -> None:
        """Caches beyond their bounds keep short stretches, or those that the last texts used, or, if that is too much, nothing."""
        self.size += sum(map(len, new)) * 4 + sum(map(len, map(self.stretches.__getitem__, new)))
        if self.size > CACHE_BYTES:
            self._keep(s for s in self.stretches if len(s) <= SHORT)
        if len(self.stretches) > CACHE_ENTRIES or self.size > CACHE_BYTES:
            self._keep(s for some in used for s in some if len(s) <= SHORT)
            if len(self.stretches) > CACHE_ENTRIES or self.size > CACHE_BYTES:
                self._keep(())
        if len(self.pieces) > CACHE_ENTRIES or not self.stretches:
            self.pieces = {}

    def _keep(self, kept) -> None:
        self.stretches = {s: self.stretches[s] for s in kept if s in self.stretches}
        self.size = sum(map(len, self.stretches)) * 4 + sum(map(len, self.stretches.values()))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return self._encode(texts)
        split, plain, other = [], set(), set()
        for t in texts:
            if any(s in t for s in self.specials):
                split.append(None)
            elif self._exotic.search(t):
                split.append(self._stretch.findall(t))
                other.update(split[-1])
            else:
                split.append(t.lower().split())
                plain.update(split[-1])
        mixed = {s for s in other if not self._exotic.search(s)}
        other -= mixed
        plain.update(map(str.lower, mixed))
        known = self.stretches  # a difference of sets would walk through the whole cache
        fresh, strange = [s for s in plain if s not in known], [s for s in other if s not in known]
        self._learn(fresh, strange)
        capital = [s for s in mixed if s not in self.stretches]
        self.stretches.update([(s, self.stretches[s.lower()]) for s in capital])
        get = self.stretches.__getitem__
        out = [b"".join(map(get, x)) if x is not None else self._encode([t])[0] for t, x in zip(texts, split, strict=True)]
        self._bounded((plain, other, mixed), fresh + strange + capital)
        return out


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker: its caches stay warm between partitions."""
    return WordEncoder(path)


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printable bytes for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def cuts_of(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts within one document as (position, penalty); the last is its end and costs nothing."""
    n = len(ids)
    stop = np.flatnonzero(ends[np.minimum(ids[: n - 1], len(ends) - 1)]) + 1
    stop = stop[stop < n - 1] if n > 1 else stop[:0]
    edges = np.concatenate([[0], stop, [n]])
    wide = np.flatnonzero(np.diff(edges) > STEP)
    inner = [np.arange(edges[i] + STEP, edges[i + 1], STEP) for i in wide]
    at = np.concatenate([stop, [n], *inner])
    cost = np.concatenate([np.full(len(stop), SENTENCE_CUT), [0], *(np.full(len(x), WORD_CUT) for x in inner)])
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


class Chains:
    """The cheapest chains of cuts from 0 with steps of at most ``window``, over a stream of cuts that goes on."""

    def __init__(self, window: int):
        self.window = window
        self.points, self.back, self.keys = [0], [0], [0]  # keys: cost + point, all that a start contributes
        self.queue = deque([0])  # the starts that can still begin a window, by rising point and rising key

    def extend(self, at: list[int], cost: list[int]) -> None:
        window, points, back, keys, queue = self.window, self.points, self.back, self.keys, self.queue
        keep, drop, shift, came, worth = queue.append, queue.pop, queue.popleft, back.append, keys.append
        j = len(points)
        points.extend(at)
        i, last = queue[0], keys[queue[-1]]
        head, base = points[i], keys[i] + window  # the padding takes off what the point adds
        for here, price in zip(at, cost, strict=True):
            while here - head > window:
                shift()
                i = queue[0]
                head, base = points[i], keys[i] + window
            key = base + price
            came(i)
            worth(key)
            while last >= key:  # never the first, whose key is smaller by a window
                drop()
                last = keys[queue[-1]]
            keep(j)
            last = key
            j += 1

    def _chain(self, j: int) -> list[int]:
        out = []
        while j:
            out.append(j)
            j = self.back[j]
        return out[::-1]

    def _take(self, chain: list[int]) -> list[int]:
        """The cuts of ``chain``, the beginning of all live chains; the last of them is where the rest begins."""
        cuts = [self.points[j] for j in chain]
        if chain:
            at = chain[-1]
            self.points, self.keys = self.points[at:], self.keys[at:]
            self.back = [max(i - at, 0) for i in self.back[at:]]
            self.queue = deque(i - at for i in self.queue)
        return cuts

    def settled(self) -> list[int]:
        """The cuts that all live chains share."""
        live = {*self.queue}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.back[last])
        return self._take(self._chain(live.pop()))

    def forced(self) -> list[int]:
        """All but the last eighth of the cheapest chain; the others end here, and what follows is weighed anew."""
        chain = self._chain(self._cheapest())
        if not chain:
            return []
        taken = chain[: max(1, len(chain) - len(chain) // 8)]
        cuts, at = [self.points[j] for j in taken], taken[-1]
        points, prices = self.points[at:], [key - self.keys[i] - self.window for key, i in zip(self.keys[at + 1 :], self.back[at + 1 :], strict=True)]
        self.points, self.back, self.keys, self.queue = points[:1], [0], [points[0]], deque([0])
        self.extend(points[1:], prices)
        return cuts

    def _cheapest(self) -> int:
        """The start that leaves less than a window at the least cost so far; what is not in the queue is never cheaper."""
        return min((i for i in self.queue if self.points[-1] - self.points[i] < self.window), key=lambda i: (self.keys[i] - self.points[i], -i))

    def best(self) -> list[int]:
        """The cuts of the cheapest chain that leaves less than a window."""
        return [self.points[j] for j in self._chain(self._cheapest())]


def best_cuts(at: list[int], cost: list[int], window: int) -> list[int]:
    """The cheapest chain of cuts from 0 with steps of at most ``window``, up to a cut that leaves less than a window."""
    chains = Chains(window)
    chains.extend(at, cost)
    return chains.best()


def tail_cuts(n: int) -> list[int]:
    """Ends of the pieces of the last, incomplete window: powers of two, which need no padding."""
    out, at = [], 0
    while at < n:
        at += 1 << ((n - at).bit_length() - 1)
        out.append(at)
    return out


class Packer:
    """Packs one partition's stream of documents; ``rows`` gathers finished pieces."""

    def __init__(self, partition: int, ends: np.ndarray, window: int, stretch: int = STRETCH, horizon: int = HORIZON):
        self.ends, self.stretch, self.horizon = ends, stretch, horizon
        self.sequence = partition << 32
        self.docs: list[tuple] = []  # (doc_id, ids as bytes, tokens, first token not packed yet)
        self.chains = Chains(window)
        self.seen = self.packed = 0  # tokens of the stream so far
        self.due = stretch
        self.rows: list[tuple] = []

    def add(self, doc_id, blob: bytes) -> None:
        ids = np.frombuffer(blob, dtype="<u4")
        at, cost = cuts_of(ids, self.ends)
        self.docs.append((doc_id, blob, len(ids), 0))
        self.chains.extend((at + self.seen).tolist(), cost.tolist())
        self.seen += len(ids)
        if self.seen >= self.due:
            self._emit(self.chains.settled())
            while self.seen - self.packed >= self.horizon:
                self._emit(self.chains.forced())
            self.due = self.seen + self.stretch

    def close(self) -> None:
        if self.seen > self.packed:
            cuts = self.chains.best()
            last = cuts[-1] if cuts else self.packed
            self._emit(cuts + [last + x for x in tail_cuts(self.seen - last)])

    def _emit(self, cuts: list[int]) -> None:
        at, k = self.packed, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc_id, blob, total, used = self.docs[k]
                n = min(total - used, cut - at)
                self.rows.append((doc_id, used, n, zlib.crc32(memoryview(blob)[4 * used : 4 * (used + n)]), total, self.sequence, offset, blob[4 * used : 4 * (used + n)]))
                offset += n
                at += n
                self.docs[k] = (doc_id, blob, total, used + n)
                k += used + n == total
            self.sequence += 1
        self.docs = self.docs[k:]
        self.packed = at


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, window: int, keep_ids: bool):
    def run(batches):
        encoder, packer = _encoder(path), None
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            packer = packer or Packer(TaskContext.get().partitionId(), encoder.ends, window)
            for part, _, _ in tb.slices(batch, "text"):
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                for doc_id, blob in zip(part.column("id").to_pylist(), encoder(texts), strict=True):
                    packer.add(doc_id, blob + end)
                yield from _rows(packer, keep_ids)
        if packer:
            packer.close()
            yield from _rows(packer, keep_ids)

    return run


def _rows(packer: Packer, keep_ids: bool):
    if packer.rows:
        columns = list(zip(*packer.rows, strict=True))
        packer.rows = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if keep_ids:
            names.append("ids")
            tokens = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in columns[7]]
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(tokens))))
        yield pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    There is no shuffle: every input partition is packed in its own order, and
    sequence ids carry the partition number in their upper half.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")
    return texts.mapInArrow(_pack(tokenizer or tokenizer_file(), window, keep_ids), schema)
