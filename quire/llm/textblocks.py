"""Vectorised views of Arrow string columns for the per-partition helpers.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; UTF-8
continuation bytes never fall in that set, so byte runs equal code point runs.
Everything works on slices of a few megabytes, so the memory of a Python worker
does not follow the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        if n > SLICE_BYTES + (1 << 16):
            return both[0], both[1]  # one very long text: the tables are not kept
        _powers[base] = have = (both[0], both[1])
    return have


@dataclass
class Words:
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, stream: int = 0) -> np.ndarray:
        """A 64-bit content hash per word; streams are independent of each other."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        up, down = _power_tables(_BASES[stream], len(self.data) + 1)
        n = len(self.data)
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        raw = (total[self.end] - total[self.start]) * down[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def text(self, a: int, b: int) -> bytes:
        return self.data[a:b].tobytes()


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, nulls as empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes, at least one row each."""
    data, offsets = byte_view(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive hashes (those that cross texts are for the caller to drop)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` words that lie within one text."""
    count = np.diff(first) - width + 1
    ok = count > 0
    begin, count = first[:-1][ok], count[ok]
    if not len(begin):
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.arange(int(count.sum())) + shift
