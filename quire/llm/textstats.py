"""Counts per text that quality rules and classifiers share, computed slice by slice."""

from __future__ import annotations

import numpy as np

from quire.llm import textblocks as tb

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL = _flags(SYMBOLS)
_UPPER = _flags(bytes(range(0x41, 0x5B)))
_DIGIT = _flags(b"0123456789")
_STOP = _flags(b".,;:?")
_BANG = _flags(b"!")
_BAR = _flags(b"|")


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``first``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text in windows of ``width`` words that the text holds at least twice."""
    starts = tb.inside(first, width)
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(starts):
        doc = np.searchsorted(first, starts, side="right").astype(np.uint64)
        key = tb.rolling(hashes, width)[starts] ^ tb.mix(doc)
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            at = starts[twice[place] == key]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + width, -1)
    return per_text(np.cumsum(covered[:-1]) > 0, first)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line."""
    raw = data.tobytes()
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    for i in range(len(out)):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


def counts(words: tb.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets = words.data, words.offsets
    return {
        "n_words": np.diff(words.first),
        "word_chars": per_text(((data & 0xC0) != 0x80) & ~tb._SPACE[data], offsets),
        "n_symbols": per_text(_SYMBOL[data], offsets),
        "n_dup_lines": duplicate_lines(data, offsets),
        "n_repeat_words": repeated_words(hashes, words.first),
    }


STYLE = ("words", "word_length", "symbols", "bars", "bangs", "upper", "digits", "stops", "distinct", "stutter", "dup_lines", "repeats", "foreign")


def style(words: tb.Words) -> np.ndarray:
    """A row of dense features per text, in the order of ``STYLE``."""
    hashes = words.hashes()
    data, offsets = words.data, words.offsets
    got = counts(words, hashes)
    n = np.maximum(got["n_words"], 1).astype(float)
    chars = np.maximum(got["word_chars"], 1).astype(float)
    doc = words.doc
    distinct = np.zeros(len(n))
    if len(hashes):
        order = np.argsort(hashes ^ tb.mix(doc.astype(np.uint64)))
        h, d = hashes[order], doc[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d[new], minlength=len(n))
    stutter = np.zeros(len(hashes), dtype=bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    share = lambda flags: per_text(flags[data], offsets) / chars
    return np.column_stack([
        np.log1p(got["n_words"]), got["word_chars"] / n, np.sqrt(share(_SYMBOL)), np.sqrt(share(_BAR)), np.sqrt(share(_BANG)), share(_UPPER), share(_DIGIT), share(_STOP),
        np.log(np.maximum(distinct, 1)) / np.log(n + 1), per_text(stutter, words.first) / n, got["n_dup_lines"] / n * 10, got["n_repeat_words"] / n, per_text(data >= 0xC0, offsets) / chars,
    ])
