"""Near-duplicates by SimHash fingerprints, searched in vantage-point trees.

Words are lower-cased (A to Z only); every three of them, joined by spaces, vote
with their XXH64 on the 64 bits of a text's fingerprint, repeats included. Two
fingerprints are linked at ``RADIUS`` or fewer differing bits; a component is what
links reach.

Equal fingerprints are one point, so groups of copies never meet in a task. A
vantage-point tree over a bounded sample (``PER_SHARD`` points for each of at most
``MAX_SHARDS`` leaves) cuts the points into shards: a node sends a point inside if
its Hamming distance to the vantage point is at most the node's limit. The vantage
point and limit are those, of ``TRIES`` vantage points and all limits, that leave
the fewest comparisons. By the triangle bound, what is linked to an inside point
at distance d lies outside only if d + ``RADIUS`` exceeds the limit; such a point
goes there too, as a guest, and a guest follows every branch that its ball of
``RADIUS`` touches. Points at home outside are not sent inside, so two linked
points meet in exactly one shard, at least one of them at home. A shard is searched
by the same tree, cut further until leaves are small, and gives a spanning forest
of its links, never all of them.

The number of guests is the price of exactness: distances to a vantage point lie
close together in 64 dimensions, so a level of the tree halves the points but sends
up to a half of the guests to both sides.

Defined results: a null text has no words; without words the fingerprint is zero
and linked like any other; one or two words are one shingle; rows that share a
doc_id are judged each by its own text; a null doc_id stays null and never names a
component unless all ids in it are null; an empty table gives no rows. A very long
text is a slice of its own, hashed in pieces. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textblocks as tb
from quire.llm.components import components
from quire.llm.recovery import checkpointed
from quire.llm.skew import hot_keys, spread_join

SHINGLE = 3
SEED = 42
RADIUS = 2
SHARD_ROWS = 4096
MAX_SHARDS = 4096
PER_SHARD = 16
TRIES = 24
LEAF = 256
_PIECE = 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text."""
    words = tb.words_of(_LOWER[data], offsets)
    length = words.end - words.start
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(int(begin[-1]), 0x20, dtype=np.uint8)
    solid = np.flatnonzero(~tb._SPACE[words.data])
    joined[solid + np.repeat(begin[:-1] - words.start, length)] = words.data[solid]
    joined = joined.tobytes()
    count = np.diff(words.first)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(first[-1])) - first[doc] + words.first[doc]
    stop = begin[np.minimum(at + SHINGLE, words.first[doc + 1])] - 1
    votes = np.zeros((len(n), 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for p in range(0, len(at), _PIECE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at[p : p + _PIECE]].tolist(), stop[p : p + _PIECE].tolist(), strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = doc[p : p + _PIECE]
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        votes[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def _prints(batches):
    for batch in batches:
        for part, data, offsets in tb.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fingerprints(data, offsets).view(np.int64))], ["id", "print"])


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def best_split(points: np.ndarray, radius: int = RADIUS) -> tuple[np.uint64, int] | None:
    """(vantage point, limit) with the fewest comparisons left, or None where no split saves a tenth of them."""
    n = len(points)
    best, found = 0.9 * n * n, None
    for v in points[:: max(1, n // TRIES)][:TRIES]:
        inside = np.cumsum(np.bincount(distance(points, v), minlength=65)).astype(float)
        before = np.concatenate([np.zeros(radius), inside[: 65 - radius]])
        cost = inside**2 + (n - inside) * (n - before)
        limit = int(np.argmin(cost))
        if cost[limit] < best:
            best, found = cost[limit], (v, limit)
    return found


class Tree:
    """A vantage-point tree as flat arrays; a negative child is the leaf of that number."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int = RADIUS):
        self.radius = radius
        self.vantage, self.limit, self.child = [], [], []
        self.leaves = 0
        self.root = self._grow(sample, max(1, len(sample) // max(1, leaves)))

    def _grow(self, points: np.ndarray, small: int) -> int:
        split = best_split(points, self.radius) if len(points) > small else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        node = len(self.vantage)
        self.vantage.append(split[0])
        self.limit.append(split[1])
        self.child.append([0, 0])
        inside = distance(points, split[0]) <= split[1]
        self.child[node] = [self._grow(points[inside], small), self._grow(points[~inside], small)]
        return node

    def route(self, points: np.ndarray):
        """(leaf, indices of points, at home) of every leaf that some points go to."""
        waiting = [(self.root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while waiting:
            node, at, home = waiting.pop()
            if not len(at):
                continue
            if node < 0:
                yield -node - 1, at, home
                continue
            d = distance(points[at], self.vantage[node])
            inside, outside = branches(d, home, self.limit[node], self.radius)
            low, high = self.child[node]
            waiting.append((low, at[inside], home[inside]))
            waiting.append((high, at[outside], home[outside] & (d[outside] > self.limit[node])))


def branches(d: np.ndarray, home: np.ndarray, limit: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points go inside and which outside; an inside point at home is a guest outside."""
    return np.where(home, d <= limit, d - radius <= limit), d + radius > limit


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the same values with the same components, fewer than there are values."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = label != np.arange(len(values))
    return values[some], values[label[some]]


def linked(points: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``radius`` that have an end at home, among distinct points."""
    none = np.zeros(0, dtype=points.dtype)
    out_a, out_b, size = [none], [none], 0
    waiting = [(points, home)]
    while waiting:
        points, home = waiting.pop()
        own = points[home]
        if not len(own) or len(points) < 2:
            continue
        split = best_split(own[:: max(1, len(own) // 512)], radius) if len(own) > LEAF else None
        if split is not None:
            d = distance(points, split[0])
            inside, outside = branches(d, home, split[1], radius)
            waiting.append((points[inside], home[inside]))
            waiting.append((points[outside], home[outside] & (d[outside] > split[1])))
            continue
        for p in range(0, len(own), LEAF):
            i, j = np.nonzero(np.bitwise_count(own[p : p + LEAF, None] ^ points[None, :]) <= radius)
            a, b = own[p + i], points[j]
            if (differ := a != b).any():
                a, b = forest(a[differ], b[differ])
                out_a.append(a)
                out_b.append(b)
                size += len(a)
        if size > 1 << 20:
            a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b, size = [a], [b], 0
    return forest(np.concatenate(out_a), np.concatenate(out_b))


def _place(tree: Tree):
    def run(batches):
        for batch in batches:
            points = np.asarray(batch.column("print")).view(np.uint64)
            for leaf, at, home in tree.route(points):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, dtype=np.int32)), pa.array(points[at].view(np.int64)), pa.array(home)], ["shard", "print", "home"])

    return run


def _search(radius: int):
    def run(table: pa.Table) -> pa.Table:
        points = table.column("print").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy().astype(bool)
        a, b = linked(points, home, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A forest (a, b) that joins what links of at most ``radius`` bits reach among distinct ``points`` (print)."""
    n = points.count()
    shards = int(min(MAX_SHARDS, max(1, n // SHARD_ROWS)))
    sample = points.select("print").orderBy(F.xxhash64("print"), "print").limit(shards * PER_SHARD).toPandas()["print"].to_numpy(dtype=np.int64)
    tree = Tree(sample.view(np.uint64), shards, radius)
    placed = points.select("print").mapInArrow(_place(tree), "shard int, print long, home boolean")
    return placed.groupBy("shard").applyInArrow(_search(radius), "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(texts.mapInArrow(_prints, "id long, print long"))
    points = checkpointed(rows.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    reached = components(links(points, radius)).withColumnRenamed("id", "print")
    named = checkpointed(points.join(reached, "print", "left").withColumn("root", F.coalesce("root", "print")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("points"))
    named = spread_join(named.select("print", "root", "n"), least.select("root", "component_id"), "root", hot_keys(least, "root", "points"), F.col("print"))
    found = spread_join(rows, named.select("print", "component_id"), "print", hot_keys(points, "print"), F.col("id"))
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
