"""Near-duplicate documents by DartMinHash signatures.

A document is a weighted set of shingles of five words. Every unit of an
element's weight is a strip of the plane (weight x rank) in which hashed darts
fall as a Poisson process, the same darts for the same strip in every document.
A document sees the darts of its strips up to a rank that yields about
``k (ln k + 2)`` of them, deals each to one of ``k`` coordinates and keeps the
earliest per coordinate; where a coordinate stays empty it looks up to twice the
rank. Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity.

Equal texts are one node. Nodes that agree in a band share a bucket. Every node
of a bucket is first compared exactly with the bucket's lead, its smallest node:
a bucket of m rows gives m - 1 comparisons, and those alike form classes. Only in
buckets that still hold several classes pairs between classes are compared too, in
blocks of bounded size and only those that share one of their rarest shingles, without
which they cannot be alike; so documents of one template that differ enough do not meet,
and candidates meet through a band they share and
never through a chain of others. Similarity is at least 0.8 by default. With
``weights="set"`` (the production value) each distinct shingle weighs one, with
``"count"`` as often as it occurs.

Defined results: a null text is alone in its class; equal texts, empty ones
included, share a class; a text of one to four words is one shingle; a class is
named by its smallest doc_id; rows that share a doc_id are classed each by its
own text (classes that have that id as their smallest share its name), a null
doc_id sorts first; a very long text is a slice of its own. A
pair at similarity 0.8 shares no band with probability below 0.0001. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textblocks as tb
from quire.llm.components import components
from quire.llm.recovery import checkpointed
from quire.llm.skew import hot_keys, spread_join

SHINGLE = 5
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
BLOCK_SHINGLES = 500_000
BLOCK_PAIRS = 1 << 18
_GOLD = 0x9E3779B97F4A7C15
_NO_ID = -(1 << 63)


def shingles(words: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and where those of each text begin."""
    names = words.hashes()
    count = np.diff(words.first)
    full = tb.rolling(names, SHINGLE)[tb.inside(words.first, SHINGLE)] if len(names) >= SHINGLE else np.zeros(0, np.uint64)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(first[-1]), dtype=np.uint64)
    short = np.zeros(len(out), dtype=bool)
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        h = np.array([count[i]], dtype=np.uint64)
        for name in names[words.first[i] : words.first[i + 1]]:
            h = tb.mix(h * np.uint64(0x9FB21C651E98DF25) + name)
        out[first[i]] = h[0]
        short[first[i]] = True
    out[~short] = full
    return out, first


def _strips(elements: np.ndarray, first: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each unit strip."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if weights == "set":
        return doc, elements
    order = np.lexsort((elements, doc))
    e, d = elements[order], doc[order]
    new = np.ones(len(e), dtype=bool)
    new[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    nth = np.arange(len(e)) - np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    return d, tb.mix(e + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def signatures(elements: np.ndarray, first: np.ndarray, k: int, weights: str = "set") -> np.ndarray:
    """k coordinates per document: the hash of the earliest dart of each. Rows of documents without shingles are meaningless."""
    docs = len(first) - 1
    doc, strip = _strips(elements, first, weights)
    size = np.diff(first)
    out = np.zeros((docs, k), dtype=np.uint64)
    reach = np.where(size > 0, k * (np.log(k) + 2) / np.maximum(size, 1), 0.0)
    open_docs = size > 0
    while open_docs.any():
        pick = np.flatnonzero(open_docs[doc])
        at, seed = doc[pick], strip[pick]
        time = np.zeros(len(at))
        cells, times, darts = [], [], []
        arrival = 0
        while len(at):
            arrival += 1
            dart = tb.mix(seed + np.uint64(arrival * _GOLD & tb._MASK))
            unit = ((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            near = unit >= np.exp(time - reach[at])
            at, seed, dart, time = at[near], seed[near], dart[near], time[near] - np.log(unit[near])
            cells.append(at * k + (tb.mix(dart ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(k)).astype(np.int64))
            times.append(time)
            darts.append(dart)
        cell, when, dart = np.concatenate(cells), np.concatenate(times), np.concatenate(darts)
        earliest = np.full(docs * k, np.inf)
        np.minimum.at(earliest, cell, when)
        best = when == earliest[cell]
        out.reshape(-1)[cell[best]] = dart[best]
        done = open_docs & np.isfinite(earliest.reshape(docs, k)).all(axis=1)
        open_docs &= ~done
        reach[open_docs] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(signature), (b + 1) * _GOLD & tb._MASK, dtype=np.uint64)
        for r in range(rows):
            h = tb.mix(h * np.uint64(0x9FB21C651E98DF25) + signature[:, b * rows + r])
        keys[:, b] = h
    return keys


def _list(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch(weights: str):
    def run(batches):
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                elements, first = shingles(tb.words_of(data, offsets))
                size = np.diff(first)
                keys = band_keys(signatures(elements, first, BANDS * ROWS, weights), BANDS, ROWS)
                some = size > 0
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("print"), pa.array(size), _list(keys[some].reshape(-1), np.where(some, BANDS, 0))], ["id", "print", "n", "keys"])

    return run


def _elements(batches):
    for batch in batches:
        for part, data, offsets in tb.slices(batch, "text"):
            elements, first = shingles(tb.words_of(data, offsets))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("class"), part.column("places"), _list(elements, np.diff(first))], ["node", "class", "places", "elements"])


def star_pairs(lead: int, nodes: np.ndarray, elements: np.ndarray, first: np.ndarray, similarity: float, weights: str) -> list[tuple[int, int]]:
    """(node, lead) of the nodes with at least this similarity to the lead, which is among them."""
    doc, strip = _strips(elements, first, weights)
    order = np.lexsort((strip, doc))
    doc, strip = doc[order], strip[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (strip[1:] != strip[:-1])
    doc, strip = doc[new], strip[new]
    own = np.flatnonzero(nodes == lead)
    if not len(own):
        return []
    mine = strip[doc == own[0]]
    size = np.bincount(doc, minlength=len(nodes))
    at = np.minimum(np.searchsorted(mine, strip), max(len(mine) - 1, 0))
    both = np.bincount(doc[mine[at] == strip], minlength=len(nodes)) if len(mine) else np.zeros(len(nodes))
    near = (size > 0) & (both >= similarity * (size + len(mine) - both) - 1e-9) & (nodes != lead)
    return [(int(x), int(lead)) for x in nodes[near]]


def candidates(doc: np.ndarray, name: np.ndarray, often: np.ndarray, label: np.ndarray, similarity: float):
    """Pairs (x, y) of documents of different labels that share one of their rarest elements, in runs of bounded size.

    ``doc`` and ``name`` list the distinct elements of the documents, ``often`` how many
    documents have an element. Two sets at the similarity or above share an element
    among the first n - ceil(similarity n) + 1 of each, in any order that both follow;
    by rising frequency these are what the documents of one template do not share.
    """
    order = np.lexsort((name, often[name], doc))
    doc, name = doc[order], name[order]
    size = np.bincount(doc, minlength=len(label))
    place = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
    head = place < (size - np.ceil(similarity * size - 1e-9) + 1)[doc]
    doc, name = doc[head], name[head]
    order = np.lexsort((label[doc], name))
    doc, name = doc[order], name[order]
    # of an element, each document meets those of later labels
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (label[doc[1:]] != label[doc[:-1]])])
    after = np.searchsorted(name, name, side="right")
    run = np.flatnonzero(new)
    stop = np.concatenate([run[1:], [len(doc)]])[np.cumsum(new) - 1]
    count = after - stop
    upto, at = np.cumsum(count), 0
    while at < len(doc):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_PAIRS, side="right")))
        n = count[at:end]
        left = np.repeat(np.arange(at, end), n)
        right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + stop[left]
        x, y = doc[left], doc[right]
        pair = np.unique(np.minimum(x, y) * len(label) + np.maximum(x, y))
        yield pair // len(label), pair % len(label)
        at = end


def joined_pairs(ids: np.ndarray, classes: np.ndarray, elements: np.ndarray, first: np.ndarray, similarity: float, weights: str) -> list[tuple[int, int]]:
    """Links between the given classes whose documents have at least this similarity (a spanning forest)."""
    m = len(ids)
    doc, strip = _strips(elements, first, weights)
    if not len(doc):
        return []
    name, inverse = np.unique(strip, return_inverse=True)
    pair = np.unique(doc * len(name) + inverse)
    doc, inverse = pair // len(name), pair % len(name)
    size = np.bincount(doc, minlength=m)
    begin = np.concatenate([[0], np.cumsum(size)])
    label = np.unique(classes, return_inverse=True)[1]
    mark = np.zeros(len(name), dtype=bool)
    links = []
    for left, right in candidates(doc, inverse, np.bincount(inverse, minlength=len(name)), label.copy(), similarity):
        near = np.minimum(size[left], size[right]) >= similarity * np.maximum(size[left], size[right]) - 1e-9
        left, right = left[near], right[near]
        cuts = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1], [True]])) if len(left) else np.zeros(1, np.int64)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            x, others = left[s], right[s:e]
            others = others[label[others] != label[x]]
            if not len(others):
                continue
            own = inverse[begin[x] : begin[x + 1]]
            mark[own] = True
            n = size[others]
            at = np.repeat(begin[others] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            both = np.add.reduceat(mark[inverse[at]].astype(np.int64), np.cumsum(n) - n)
            mark[own] = False
            for y in others[both >= similarity * (len(own) + n - both) - 1e-9]:
                if label[y] != label[x]:
                    links.append((int(ids[x]), int(ids[y])))
                    label[label == label[y]] = label[x]
    return links


def _verify(similarity: float, weights: str, stars: bool):
    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        table = table.combine_chunks().sort_by([("root", "ascending"), ("node", "ascending")])
        root, nodes, classes = (np.asarray(table.column(c)) for c in ("root", "node", "class"))
        listed = table.column("elements").combine_chunks()
        listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
        begin = np.asarray(listed.offsets).astype(np.int64)
        values = np.asarray(listed.values).view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(root[1:] != root[:-1]) + 1, [len(root)]])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            own = values[begin[s] : begin[e]], begin[s : e + 1] - begin[s], similarity, weights
            for x, y in star_pairs(root[s], nodes[s:e], *own) if stars else joined_pairs(nodes[s:e], classes[s:e], *own):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links(texts: DataFrame, nodes: DataFrame, met: DataFrame, stars: bool, similarity: float, weights: str) -> DataFrame:
    """Verified links (a, b) among the nodes that meet under a root: (node, class, root, n) in ``met``.

    The nodes of a root are cut into parts of about ``BLOCK_SHINGLES`` shingles. With
    ``stars`` the root itself comes to every part, otherwise every two parts meet.
    """
    whole = met.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"), F.count("*").alias("rows"))
    whole = checkpointed(whole)
    bins = int(met.agg(F.ceil(F.sum("n") / BLOCK_SHINGLES)).first()[0] or 1) * 4
    placed = spread_join(met, whole, "root", hot_keys(whole, "root", "rows"), F.col("node"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    if stars:
        parts = F.when(F.col("node") == F.col("root"), F.transform(every, lambda j: F.xxhash64("root", j))).otherwise(F.array(F.xxhash64("root", part)))
    else:
        parts = F.transform(every, lambda j: F.xxhash64("root", F.least(part, j), F.greatest(part, j)))
    small = F.array(F.pmod(F.xxhash64("root"), F.lit(bins)))
    places = F.transform(F.when(F.col("parts") > 1, parts).otherwise(small), lambda g: F.struct(g.alias("group"), F.col("root").alias("root")))
    placed = placed.select("node", "class", places.alias("places")).groupBy("node").agg(F.any_value("class").alias("class"), F.flatten(F.collect_list("places")).alias("places"))
    named = placed.join(nodes.select("node", "first", "print"), "node")
    members = texts.join(named, (texts["id"] == named["first"]) & (texts["print"] == named["print"])).select("node", "class", "places", "text")
    members = members.mapInArrow(_elements, "node long, class long, places array<struct<group:long,root:long>>, elements array<long>")
    members = members.select("node", "class", F.explode("places").alias("place"), "elements").select("node", "class", F.col("place.group").alias("group"), F.col("place.root").alias("root"), "elements")
    return checkpointed(members.groupBy("group").applyInArrow(_verify(similarity, weights, stars), "a long, b long").distinct())


def _nodes(sketch: DataFrame) -> DataFrame:
    """(print, first, n, keys, node): distinct texts, the smallest id of each, and a number for the text, which is that id wherever it names one text only."""
    found = checkpointed(sketch.where("print is not null").groupBy("print").agg(F.min("id").alias("first"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")))
    shared = found.groupBy("first").agg(F.count("*").alias("same")).where("same > 1")
    if shared.isEmpty():
        return found.withColumn("node", F.col("first"))
    node = F.when(F.col("same").isNull(), F.col("first")).otherwise(F.xxhash64("first", "print"))
    return checkpointed(found.join(shared, "first", "left").withColumn("node", node).drop("same"))


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, weights: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, print) of ``docs``, and (print, first, root, class_id) of every distinct text; root is another number for the class."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("print", F.unhex(F.md5("text")))
    sketch = checkpointed(texts.mapInArrow(_sketch(weights), "id long, print binary, n long, keys array<long>"))
    if not sketch.groupBy("id", "print").agg(F.count("*").alias("same")).where("same > 1").isEmpty():
        texts = texts.dropDuplicates(["id", "print"])  # repeated rows count once in the comparison
    nodes = _nodes(sketch)
    banded = nodes.select("node", "n", F.explode("keys").alias("key"))
    buckets = checkpointed(banded.groupBy("key").agg(F.min("node").alias("root"), F.max("node").alias("last"), F.count("*").alias("rows")).where("root < last").drop("last"))
    hot = hot_keys(buckets, "key", "rows")
    banded = checkpointed(spread_join(banded, buckets.select("key", "root"), "key", hot, F.col("node")))
    own = F.col("node").alias("class")
    met = checkpointed(banded.select("node", own, "root", "n").distinct())
    links = _links(texts, nodes, met, True, similarity, weights)
    first = components(links).withColumnRenamed("id", "node")
    classed = checkpointed(banded.join(first.withColumnRenamed("root", "class"), "node", "left").select("key", "node", "n", F.coalesce("class", "node").alias("class")))
    # of buckets with equal members one is enough
    mixed = classed.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    mixed = checkpointed(mixed.where("a < b and rows > 2").groupBy("rows", "x", "y").agg(F.min("key").alias("key")))
    met = checkpointed(spread_join(classed, mixed.select("key"), "key", hot_keys(mixed, "key", "rows"), F.col("node"), "left_semi").select("node", "class", F.col("key").alias("root"), "n"))
    more = _links(texts, nodes, met, False, similarity, weights)
    classes = components(links.unionByName(more)) if not more.isEmpty() else first.withColumnRenamed("node", "id")
    named = nodes.join(classes.withColumnRenamed("id", "node"), "node", "left").select("print", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("rows"))
    named = spread_join(named, least.select("root", "class_id"), "root", hot_keys(least, "root", "rows"), F.col("print"))
    return sketch.select("id", "print"), checkpointed(named.select("print", "first", "root", "class_id"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, weights: str = "set") -> DataFrame:
    """One row (doc_id, class_id) per row of ``docs``; class_id is the smallest doc_id of its near-duplicate class."""
    rows, named = _classes(docs, id_col, text_col, similarity, weights)
    hot = hot_keys(rows.where("print is not null").groupBy("print").agg(F.count("*").alias("n")), "print")
    known = spread_join(rows.where("print is not null"), named.select("print", "class_id"), "print", hot, F.col("id")).select("id", "class_id")
    known = known.unionByName(rows.where("print is null").select("id", F.col("id").alias("class_id")))
    given = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return known.select(given("id").alias(id_col), given("class_id").alias("class_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class with all columns: of those with the smallest id and, among these, the smallest text hash, the first.

    Rows whose id or text is null stay as they are. Rows that share the id of a
    class but belong to another class are judged there.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    own_id, own_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    bare = F.col(own_id).isNull() | F.col(own_text).isNull()
    _, named = _classes(rows.where(~bare), own_id, own_text, SIMILARITY, "set")
    best = named.where("first = class_id").groupBy("root", "class_id").agg(F.min("print").alias("print")).select("class_id", "print")
    kept = rows.where(~bare).withColumn("print", F.unhex(F.md5(F.col(own_text).cast("string")))).withColumn("class_id", F.col(own_id).cast("long")).join(best, ["class_id", "print"], "left_semi")
    # repeated rows are rare: only they are grouped
    times = checkpointed(kept.groupBy("class_id", "print").agg(F.count("*").alias("times")).where("times > 1"))
    if not times.isEmpty():
        again = kept.join(times, ["class_id", "print"], "left_semi").groupBy("class_id", "print").agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("row")).select("row.*")
        kept = kept.join(times, ["class_id", "print"], "left_anti").select(*names).unionByName(again)
    return kept.select(*names).unionByName(rows.where(bare)).toDF(*docs.columns)
