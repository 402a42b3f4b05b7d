"""Quality rules with a hashed n-gram classifier.

Word unigrams, word bigrams and character trigrams (of UTF-8 bytes) are hashed
into tables of weights; a text's score is the sum over the three families of the
mean weight of its n-grams. The weights are logistic regression on labelled
quality rows, a bounded sample of ``SAMPLE`` documents, whose n-grams are hashed
in the tasks; only these lists, of at most ``MOST_ENTRIES`` n-grams a document (a
sample by hash of those of a longer one), reach the driver: 330 MB at most, however
long the texts are. A fifth of the sample is held out to turn scores into probabilities. All
texts are scored whole, in Arrow batches, against fixed thresholds. A score is
summed in whole numbers (units of 2^-32), so it does not depend on how the table
is cut into batches.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; without labels of both kinds the base rules alone decide, while one
label of each kind is enough for a fit; rows that share a doc_id are scored each for itself; a very long text is a slice of its
own. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import labelled, textstats
from quire.llm import textblocks as tb

SAMPLE = 2500
MOST_ENTRIES = 1 << 14
BITS = 17
STEPS = 60
KEEP_FROM = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FAMILIES = 3
UNIT = 2.0**32
_STUTTER = np.uint64(0xB5297A4D3F84D5B5)


def grams(words: tb.Words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the buckets of all n-grams, and where those of each text begin."""
    shift = np.uint64(64 - BITS)
    pairs = tb.inside(words.first, 2)
    two = np.zeros(0, np.uint64)
    if len(pairs):
        a, b = hashes[pairs], hashes[pairs + 1]
        two = np.where(a == b, _STUTTER, tb.mix(a * np.uint64(0x9FB21C651E98DF25) + b))
    data, offsets = words.data.astype(np.uint32), words.offsets
    triples = tb.inside(offsets, 3)
    three = np.zeros(0, np.uint32)
    if len(triples):
        rolled = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
        three = (rolled[triples] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    begin = lambda first, n: np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - n + 1, 0))])
    return [((hashes >> shift).astype(np.int32), words.first), ((two >> shift).astype(np.int32), begin(words.first, 2)), (three.astype(np.int32), begin(offsets, 3))]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def scores(self, words: tb.Words, hashes: np.ndarray) -> np.ndarray:
        total = np.full(len(words.first) - 1, self.bias)
        for table, (bucket, first) in zip(self.weights, grams(words, hashes), strict=True):
            exact = textstats.per_text(np.round(table[bucket].astype(np.float64) * UNIT).astype(np.int64), first)
            total += exact / UNIT / np.maximum(np.diff(first), 1)
        return total

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.intercept, -40, 40)))


def calibration(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make the held-out scores probabilities (Newton steps with smoothed targets)."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([scores, np.ones(len(scores))])
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - target))
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


def _bounded(row: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row and bucket, of each row at most ``MOST_ENTRIES`` entries: those of the smallest hashes, with shares that stand for the others too."""
    by = np.lexsort((tb.mix(index.astype(np.uint64)), row))
    row, index, value = row[by], index[by], value[by]
    n = np.bincount(row, minlength=1)
    first = np.cumsum(n) - n
    kept = np.arange(len(row)) - first[row] < MOST_ENTRIES
    value = (value * np.maximum(n / MOST_ENTRIES, 1.0)[row]).astype(np.float32)
    row, index, value = row[kept], index[kept], value[kept]
    by = np.lexsort((index, row))
    return row[by], index[by], value[by]


def _hashed(batches):
    """The n-grams of each text as (bucket, share of the family's n-grams)."""
    for batch in batches:
        for part, data, offsets in tb.slices(batch, "text"):
            words = tb.words_of(data, offsets)
            index, value, row = [], [], []
            for family, (bucket, first) in enumerate(grams(words, words.hashes())):
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                key, times = np.unique(doc.astype(np.int64) << BITS | bucket, return_counts=True)
                doc = key >> BITS
                index.append(((key & ((1 << BITS) - 1)) + (family << BITS)).astype(np.int32))
                value.append((times / n[doc]).astype(np.float32))
                row.append(doc)
            row, index, value = map(np.concatenate, (row, index, value))
            row, index, value = _bounded(row, index, value)
            bounds = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (index, value)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), *lists], ["id", "y", "bucket", "share"])


def fit(rows: pa.Table) -> Model | None:
    """A model from labelled (id, y, bucket, share), or None where one of the two labels is missing."""
    rows = rows.sort_by("id").combine_chunks()
    y = rows.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    index, value = (pa.concat_arrays([c.flatten() for c in rows.column(name).chunks]).to_numpy() for name in ("bucket", "share"))
    row = np.repeat(np.arange(len(y), dtype=np.int32), pc.list_value_length(rows.column("bucket")).to_numpy())
    held = np.arange(len(y)) % 5 == 4
    if y[~held].min() == y[~held].max():
        held[:] = False
    share = np.where(y == 1, 0.5 / max(y[~held].sum(), 1), 0.5 / max((1 - y[~held]).sum(), 1)) * ~held
    size = FAMILIES << BITS
    w, bias = np.zeros(size, dtype=np.float32), 0.0
    m, v, mb, vb = np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[index] * value, minlength=len(y)) + bias
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        g = np.bincount(index, weights=miss[row] * value, minlength=size).astype(np.float32) + 1e-7 * w
        gb = miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 1.0 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-7)
        bias -= 0.1 * rate * mb / (np.sqrt(vb) + 1e-7)
    z = np.bincount(row, weights=w[index] * value, minlength=len(y)) + bias
    use = held if held.any() and 0 < y[held].sum() < held.sum() else ~held
    slope, intercept = calibration(z[use], y[use])
    return Model(w.reshape(FAMILIES, -1), float(bias), slope, intercept)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _score(model):
    def run(batches):
        shared = model.value
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                words = tb.words_of(data, offsets)
                hashes = words.hashes()
                got = textstats.counts(words, hashes)
                failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
                p = shared.probabilities(shared.scores(words, hashes)) if shared else np.ones(len(failed))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(got[c].astype(np.int64)) for c in COLUMNS), pa.array(failed), pa.array(~failed & (p >= KEEP_FROM)), pa.array(p)],
                    ["id", *COLUMNS, "base_failed", "kept", "probability"],
                )

    return run


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality") -> DataFrame:
    """One row per document: the base counts, base_failed, kept, and the calibrated probability of good quality."""
    rows = labelled.sample(docs, labels, target, SAMPLE, id_col, text_col).mapInArrow(_hashed, "id long, y int, bucket array<int>, share array<float>").toArrow()
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, " + "".join(f"{c} long, " for c in COLUMNS) + "base_failed boolean, kept boolean, probability double"
    return texts.mapInArrow(_score(model), schema).withColumnRenamed("id", id_col)
