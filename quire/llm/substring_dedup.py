"""Substring dedup by recompression.

Each round names neighbouring symbols: a symbol that hashes to the left side
followed by one that hashes to the right side becomes a pair; what stays
unpaired and repeats becomes a run. Names are content fingerprints, so they are
global without a dictionary: equal substrings get equal symbols wherever they
stand, except near their ends. For every symbol the rounds track its context,
the words that suffice to make it appear. A window of ``width`` words is keyed
by the longest symbol whose context it contains, which depends on the words of
the window alone. Two equal windows therefore share a key, and only the keys
(about one for every four words) are shuffled to find out which ones occur in
two different texts. A key that a task has seen in several texts reaches the shuffle
as one row of that task, whatever their number, so a passage that a third of all
documents share does not gather in one place. Windows under such a key are then
compared by 96-bit fingerprints of all their words, over the whole corpus; runs
of windows that a slice has settled travel as one row.

A row of the table is known by its id and, where several texts share an id, by
the text's hash (``dup``, 0 elsewhere), so texts under one id do not mix.

Defined results: a null or empty text has no words and keeps nothing
(``kept`` is the empty string); texts shorter than the window lose nothing; of
equal texts the one with the smallest id is kept; rows that share a doc_id are
each judged by their own text and do not remove words from each other; a null
doc_id sorts before every id; a very long text is a slice of its own. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import textblocks as tb
from quire.llm.recovery import checkpointed

ROUNDS = 6
WIDEST = 63  # a symbol's rank has six bits for its length
SEEN_KEYS = 1 << 18  # keys that a task remembers to have met in several texts
BROADCAST_IDS = 100_000
_NO_ID = -(1 << 63)
_FAR = np.int64(1) << np.int64(60)


def _rounds(names: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """New symbols of each round as (name, words, context start, context end), for contexts of at most ``width`` words."""
    n = len(names)
    lo = np.arange(n, dtype=np.int64)
    hi = lo + 1
    size = np.ones(n, dtype=np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for level in range(1, ROUNDS + 1):
        if len(names) < 2:
            return
        same = doc[:-1] == doc[1:]
        right = (tb.mix(names + np.uint64(level * 0x632BE59BD9B4E019 & tb._MASK)) >> np.uint64(63)).astype(bool)
        head = np.flatnonzero(same & ~right[:-1] & right[1:])
        paired = np.zeros(len(names), dtype=bool)
        paired[head] = True
        paired[head + 1] = True
        # what stays unpaired is only certain together with both neighbours, and with the partner of an equal neighbour
        both_lo, both_hi = lo.copy(), hi.copy()
        both_lo[head + 1] = np.minimum(lo[head], lo[head + 1])
        both_hi[head] = np.maximum(hi[head], hi[head + 1])
        equal = same & (names[:-1] == names[1:])
        free_lo = np.concatenate([[-_FAR], np.minimum(lo[1:], np.where(same, np.where(equal, both_lo[:-1], lo[:-1]), -_FAR))])
        free_hi = np.concatenate([np.maximum(hi[:-1], np.where(same, np.where(equal, both_hi[1:], hi[1:]), _FAR)), [_FAR]])
        joined = equal & ~paired[:-1] & ~paired[1:]
        begins = np.ones(len(names), dtype=bool)
        begins[head + 1] = False
        begins[1:] &= ~joined
        at = np.flatnonzero(begins)
        length = np.diff(np.append(at, len(names)))
        last = at + length - 1
        is_pair = paired[at]
        run = ~is_pair & (length > 1)
        lo, hi = np.where(is_pair, np.minimum(lo[at], lo[last]), free_lo[at]), np.where(is_pair, np.maximum(hi[at], hi[last]), free_hi[last])
        named = names[at]
        salt = np.uint64(level * 0xD1342543DE82EF95 & tb._MASK)
        named = np.where(is_pair, tb.mix(named * np.uint64(0x2545F4914F6CDD1D) + tb.mix(names[last] + salt)), named)
        named = np.where(run, tb.mix(named ^ tb.mix(length.astype(np.uint64) + ~salt)), named)
        names, size, doc = named, np.add.reduceat(size, at), doc[at]
        fresh = np.flatnonzero((is_pair | run) & (hi - lo <= width))
        yield names[fresh], size[fresh], lo[fresh], hi[fresh]


def window_keys(names: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows and the key of each: its longest symbol, the smallest name among equals."""
    n = len(names)
    starts = tb.inside(first, width)
    top = np.uint64(tb._MASK)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    best = np.full(n, top, dtype=np.uint64)
    for name, size, lo, hi in _rounds(names, first, width):
        rank = (np.uint64(width + 1) - size.astype(np.uint64)) << np.uint64(58) | tb.mix(name) >> np.uint64(6)
        tied = np.zeros(len(hi), dtype=bool)
        tied[1:] = hi[1:] == hi[:-1]
        for pick, put in ((np.flatnonzero(~tied), False), (np.flatnonzero(tied), True)):
            far, span, own = hi[pick] - width, (lo - hi)[pick] + width, rank[pick]
            for k in range(width - 1):
                ok = np.flatnonzero((span >= k) & (far >= -k))
                at = far[ok] + k
                if not len(at):
                    continue
                if put:
                    np.minimum.at(best, at, own[ok])
                else:
                    best[at] = np.minimum(best[at], own[ok])
    bare = starts[best[starts] == top]  # no pair or run fits: the smallest word stands for the window
    if len(bare):
        ranks = tb.mix(names)
        best[bare] = ranks[bare[:, None] + np.arange(width)].min(axis=1)
    return starts, tb.mix(best[starts]) | np.uint64(2)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _combine(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (keys, ids); for each row in that order: whether it opens its key's group, and whether the group has more than one id."""
    order = np.lexsort([ids, *keys[::-1]])
    opens = np.ones(len(order), dtype=bool)
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    opens[1:] = ~same
    begin = np.flatnonzero(opens)
    last = np.append(begin[1:], len(order)) - 1
    sorted_ids = ids[order]
    several = np.repeat(sorted_ids[begin] != sorted_ids[last], np.diff(np.append(begin, len(order))))
    return order, opens, several


class _Met:
    """The latest keys that a task has met in several texts, at most ``SEEN_KEYS`` of them."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.uint64)

    def split(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted ``keys`` were met before."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), dtype=bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[place] == keys

    def add(self, keys: np.ndarray) -> None:
        self.keys = np.union1d(self.keys, keys) if len(self.keys) + len(keys) <= SEEN_KEYS else np.unique(keys[-SEEN_KEYS:])


def _anchors(width: int):
    """Keys of each text. Those that a task sees in several texts are settled there: one row stands for them in the comparison."""

    def run(batches):
        met = _Met()
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                words = tb.words_of(data, offsets)
                starts, keys = window_keys(words.hashes(), words.first, width)
                if not len(starts):
                    continue
                ids = np.asarray(part.column("rid"))[np.searchsorted(words.first, starts, side="right") - 1]
                change = np.ones(len(keys), dtype=bool)
                change[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
                keys, ids = keys[change], ids[change]
                order, opens, several = _combine([keys], ids)
                keys, ids = keys[order], ids[order]
                again = np.zeros(len(keys), dtype=bool)
                again[1:] = (keys[1:] == keys[:-1]) & (ids[1:] == ids[:-1])
                known = met.split(keys)  # their row is on its way
                settled = (several | known) & ~again
                opens &= ~known
                met.add(keys[opens & several])
                # mark 0: one text of the slice has the key in slot; 1: several; else the key, of which text rid is known to share it
                slot = np.concatenate([keys[opens], tb.mix(ids[settled].view(np.uint64) ^ keys[settled])])
                mark = np.concatenate([several[opens].astype(np.uint64), keys[settled]])
                yield pa.RecordBatch.from_arrays([_signed(slot), pa.array(np.concatenate([ids[opens], ids[settled]])), _signed(mark)], ["slot", "rid", "mark"])

    return run


def _windows(width: int):
    def run(batches):
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                words = tb.words_of(data, offsets)
                names = words.hashes()
                starts, keys = window_keys(names, words.first, width)
                if not len(starts):
                    continue
                doc = np.searchsorted(words.first, starts, side="right") - 1
                listed = part.column("keys")
                bounds = np.asarray(listed.offsets) - listed.offsets[0].as_py()
                wanted = np.asarray(listed.flatten()).view(np.uint64)
                owner = np.repeat(np.arange(len(listed)), np.diff(bounds))
                hit = np.zeros(len(starts), dtype=bool)
                # both sides sorted by (text, key): one merge finds the windows under a shared key
                a = np.lexsort((keys, doc))
                w = np.lexsort((wanted, owner))
                both_doc = np.concatenate([owner[w], doc[a]])
                both_key = np.concatenate([wanted[w], keys[a]])
                kind = np.concatenate([np.zeros(len(w), np.int8), np.ones(len(a), np.int8)])
                order = np.lexsort((kind, both_key, both_doc))
                d, k, t = both_doc[order], both_key[order], kind[order]
                group = np.ones(len(d), dtype=bool)
                group[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
                shared = np.maximum.accumulate(np.where(group, np.arange(len(d)), 0))
                ok = (t == 1) & (t[shared] == 0)
                hit[a[order[ok] - len(w)]] = True
                if not hit.any():
                    continue
                high = tb.rolling(names, width)[starts[hit]]
                low = tb.rolling(words.hashes(1), width)[starts[hit]]
                at = (starts[hit] - words.first[doc[hit]]).astype(np.int32)
                row = doc[hit]
                ids = np.asarray(part.column("id"))[row]
                order, opens, _ = _combine([high, low], ids)
                high, low, ids, at, row = high[order], low[order], ids[order], at[order], row[order]
                least = ids[np.maximum.accumulate(np.where(opens, np.arange(len(ids)), 0))]
                late = ids > least  # a smaller id of this slice has the window
                # settled windows need no comparison: a run of them is one row, its length in the lower half of tail
                by = np.lexsort((at[late], row[late]))
                at_late, row_late = at[late][by], row[late][by]
                fresh = np.ones(len(by), dtype=bool)
                fresh[1:] = (row_late[1:] != row_late[:-1]) | (at_late[1:] != at_late[:-1] + 1)
                begin = np.flatnonzero(fresh)
                length = np.diff(np.append(begin, len(by))).astype(np.uint64)
                at_late, row_late = at_late[begin], row_late[begin]
                spread = tb.mix(np.asarray(part.column("id"))[row_late].view(np.uint64) ^ tb.mix(at_late.astype(np.uint64)))
                slot = np.concatenate([high[~late], spread])
                tail = np.concatenate([low[~late] & np.uint64(0xFFFFFFFF), np.uint64(1 << 63) | length]) | np.concatenate([at[~late], at_late]).astype(np.uint64) << np.uint64(32)
                rows = np.concatenate([row[~late], row_late])
                yield pa.RecordBatch.from_arrays([_signed(slot), _signed(tail), part.column("id").take(pa.array(rows)), part.column("dup").take(pa.array(rows))], ["slot", "tail", "id", "dup"])

    return run


def _cut(width: int):
    def run(batches):
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                n, removed, kept = [], [], []
                raw = data.tobytes()
                copies = part.column("copy").to_pylist()
                found = part.column("found")
                for i in range(part.num_rows):
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    n.append(len(words))
                    if copies[i] and len(words) >= width:
                        words = []
                    elif found[i].is_valid:
                        both = np.asarray(found[i].values)
                        gone = np.zeros(len(words) + 1, dtype=np.int32)
                        np.add.at(gone, both >> 32, 1)
                        np.add.at(gone, (both >> 32) + (both & 0xFFFFFFFF) - 1 + width, -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                    removed.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): each text without the words that repeat an earlier document.

    A word goes when a window of ``width`` words covers it that also starts in
    a document with a smaller id. ``kept`` holds the other words joined by a space.
    """
    if not 2 <= width <= WIDEST:
        raise ValueError(f"width is from 2 to {WIDEST}")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = checkpointed(texts.where("text is not null").select("id", F.unhex(F.md5("text")).alias("print")).groupBy("id", "print").agg(F.count("*").alias("n")))
    several = prints.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("several"))
    many = several.count()
    if many:
        several = F.broadcast(several) if many <= BROADCAST_IDS else several
        texts = texts.join(several, "id", "left").withColumn("dup", F.when(F.col("several") & F.col("text").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("several")
        # one name for (id, dup): the id itself where that is enough
        texts = texts.withColumn("rid", F.when(F.col("dup") == 0, F.col("id")).otherwise(F.xxhash64("id", "dup")))
        named = lambda df: df
    else:
        # the name is the id, and all that is joined has the same two columns, so one exchange of the texts serves every join
        texts = texts.select(F.col("id").alias("rid"), "text")
        named = lambda df: df.withColumns({"id": F.col("rid"), "dup": F.lit(0).cast("long")})
    first = prints.groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("print", "first")
    copies = prints.join(first, "print").where("id > first").select("id", "print")
    if many:
        # the copies' names need the hash of the text, which the texts have
        marked = texts.where("text is not null").select("id", "rid", F.unhex(F.md5("text")).alias("print")).distinct()
        copies = marked.join(copies, ["id", "print"], "left_semi").select("rid").distinct()
    else:
        copies = copies.select(F.col("id").alias("rid"))
    copies = copies.withColumn("copy", F.lit(True))
    originals = texts.join(copies, "rid", "left_anti")
    keyed = originals.mapInArrow(_anchors(width), "slot long, rid long, mark long")
    slot = Window.partitionBy("slot")
    one = F.when(F.col("mark").isin(0, 1), F.col("rid"))
    keyed = keyed.select("slot", "rid", "mark", F.min(one).over(slot).alias("a"), F.max(one).over(slot).alias("b"), F.max(F.col("mark") == 1).over(slot).alias("known"))
    key = F.when(F.col("mark").isin(0, 1), F.col("slot")).otherwise(F.col("mark"))
    wanted = keyed.where("mark not in (0, 1) or known or a < b").groupBy("rid").agg(F.collect_set(key).alias("keys"))
    windows = named(texts.join(wanted, "rid")).mapInArrow(_windows(width), "slot long, tail long, id long, dup long").repartition("slot")
    windows = windows.select(
        "slot", F.col("tail").bitwiseAND(0xFFFFFFFF).alias("low"), F.shiftrightunsigned("tail", 32).bitwiseAND(0x7FFFFFFF).alias("at"), (F.col("tail") < 0).alias("late"), "id", "dup"
    )
    alike = Window.partitionBy("slot", "low")
    owned = windows.withColumn("owner", F.min(F.when(~F.col("late"), F.col("id"))).over(alike))
    run = F.shiftleft("at", 32) + F.when(F.col("late"), F.col("low")).otherwise(1)
    rid = F.when(F.col("dup") == 0, F.col("id")).otherwise(F.xxhash64("id", "dup")).alias("rid")
    found = owned.where("late or id > owner").groupBy(rid).agg(F.collect_set(run).alias("found"))
    whole = texts.join(found, "rid", "left").join(copies, "rid", "left")
    cut = named(whole).mapInArrow(_cut(width), "id long, n_words long, n_removed long, kept string")
    return cut.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(doc_id, -9223372036854775808) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rn, id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
k AS (SELECT rn, id, i, array_to_string(w[i:i + 12], ' ') AS words FROM p),
m AS (SELECT words, min(id) AS owner FROM k GROUP BY words),
g AS (SELECT DISTINCT rn, unnest(range(i, i + 13)) AS j FROM k JOIN m USING (words) WHERE id > owner),
t AS (SELECT rn, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
s AS (SELECT rn, string_agg(word, ' ' ORDER BY j) AS kept FROM t ANTI JOIN g USING (rn, j) GROUP BY rn),
r AS (SELECT rn, count(*) AS n FROM g GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (rn) LEFT JOIN s USING (rn)
"""
