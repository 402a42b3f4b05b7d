"""Spelling variants by wildcard groups, without pairs of words.

Words are runs of Latin letters, A to Z lower-cased, counted over all documents;
``variant`` takes a letter out of some of them, as the contract asks. Those of at
least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences are the vocabulary.
Two words are near if one inserted, deleted or replaced code point turns one into
the other.

Replacements: each word stands in one wildcard group per position, named by
(position, prefix, suffix). A group keeps its size and its two most frequent
words; a member has size - 1 near words there, the best being the first, or the
second where it is the first itself. All words of a group differ in one letter, so
a group has no more words than the alphabet has letters, which are 90.

Insertions and deletions: each word is cut at the first letter of every run of
equal letters, which names each shorter text once, and the cut texts join the
vocabulary. A cut that is a word counts for the word that was cut and for the word
that it is, as one more near word and as a candidate for the best; what is kept are
sums and maxima per word, added to those of the wildcard groups. Every word's ways
to a near word are disjoint, so the sums are exact.

Words are numbered in code-point order, so groups carry numbers instead of texts,
and prefixes, suffixes and cuts are named by hashes modulo an 89-bit prime; a word
of a million letters costs as much as the same letters in short words. Forms are
followed by doubling; a form has ten times the occurrences, so few rounds suffice.

Defined results: a null text has no words; rows count as they come, repeated ones
again; the id of a null doc_id is written as nothing in ``<doc_id>:<run>``; ties
between forms go to the smaller word; an empty table gives no rows. Texts are
counted one at a time and counts leave a task in blocks, so a long text needs no
more than its own words. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.recovery import checkpointed
from quire.llm.skew import hot_keys, spread_join

MIN_LENGTH = 7
MIN_COUNT = 2
FACTOR = 10
DROP_EVERY = 31
BLOCK_WORDS = 200_000
BLOCK_KEYS = 100_000
_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)
_PRIME = (1 << 89) - 1
_BASE = 0x9E3779B97F4A7C15F39CC060 % _PRIME
KEY_BYTES = 12


def variant(run: str, own: bytes, start: int) -> str:
    """The run as it counts; ``own`` is its UTF-8 and ``start`` the CRC-32 of what stands before it."""
    h = zlib.crc32(own, start)
    if h % DROP_EVERY:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _counts(batches):
    total: Counter = Counter()
    for batch in batches:
        for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
            text = text.as_py()
            if not text:
                continue
            doc = doc.as_py()
            start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
            for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                if len(word := variant(run, run.encode(), start)) >= MIN_LENGTH:
                    total[word] += n
            if len(total) >= BLOCK_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                total.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, id) of every word of the vocabulary; ids are in code-point order."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    words = texts.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    return checkpointed(checkpointed(words).sort("word").withColumn("id", F.monotonically_increasing_id()))


def keys(word: str) -> tuple[int, Iterator[tuple[int, int, bool]]]:
    """The name of a word; per position the names of the word with a wildcard and without the letter there, and whether the letter differs from the one before."""
    size = len(word)
    suffix, powers = [0] * (size + 1), [1]
    for i in range(size - 1, -1, -1):
        suffix[i] = (ord(word[i]) * powers[-1] + suffix[i + 1]) % _PRIME
        powers.append(powers[-1] * _BASE % _PRIME)

    def places():
        prefix, last = 0, ""
        for i, letter in enumerate(word):
            rest = size - i - 1
            cut = prefix * powers[rest] + suffix[i + 1]
            # the wildcard counts as a letter that no word has, so position, prefix and suffix decide
            wild = prefix * powers[rest + 1] + powers[rest] + suffix[i + 1]
            yield wild % _PRIME, cut % _PRIME, letter != last
            prefix, last = (prefix * _BASE + ord(letter)) % _PRIME, letter

    return suffix[0], places()


def _keyed(kind: str):
    """(key, id, n) of each word: its own name, its names with a wildcard, or its names without a letter."""

    def names(word):
        own, places = keys(word)
        if kind == "own":
            yield own
        elif kind == "wild":
            yield from (wild for wild, _, _ in places)
        elif len(word) > MIN_LENGTH:
            yield from (cut for _, cut, first in places if first)

    def run(batches):
        found, ids, counts = [], [], []

        def block():
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["key", "id", "n"])
            for column in (found, ids, counts):
                column.clear()
            return out

        for batch in batches:
            for word, n, i in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "id")), strict=True):
                for name in names(word):
                    found.append(name.to_bytes(KEY_BYTES))
                    ids.append(i)
                    counts.append(n)
                    if len(found) >= BLOCK_KEYS:
                        yield block()
        yield block()

    return run


def _best(n, i):
    """Orders words by occurrences, and of equal ones the smaller first."""
    return F.struct(n.alias("n"), (-i).alias("back"))


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, form, form_n): how many words are near, and the most frequent of them, of every word of (word, n, id) that has one."""
    of = lambda kind: words.mapInArrow(_keyed(kind), "key binary, id long, n long")
    group = Window.partitionBy("key")  # at most 90 words
    ranked = group.orderBy(F.col("n").desc(), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = _best(F.col("n"), F.col("id"))
    groups = of("wild").select("id", F.count("*").over(group).alias("size"), F.first(own).over(ranked).alias("top"), F.nth_value(own, 2).over(ranked).alias("next")).where("size > 1")
    parts = groups.select("id", (F.col("size") - 1).alias("near"), F.when(F.col("top.back") == -F.col("id"), F.col("next")).otherwise(F.col("top")).alias("best"))
    # a cut that is a word counts on both sides at once; nothing else of it is kept
    cuts = of("cut").join(of("own").select("key", F.col("id").alias("to"), F.col("n").alias("to_n")), "key")
    ends = F.array(F.struct("id", _best(F.col("to_n"), F.col("to")).alias("best")), F.struct(F.col("to").alias("id"), own.alias("best")))
    parts = parts.unionByName(cuts.select(F.explode(ends).alias("end")).select("end.id", F.lit(1).cast("long").alias("near"), "end.best"))
    found = parts.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return found.select("id", "n_near", (-F.col("best.back")).alias("form"), F.col("best.n").alias("form_n"))


def _roots(steps: DataFrame) -> DataFrame:
    """(id, root) of every word that has a form, from (id, form): where following forms ends."""
    now = checkpointed(steps.select("id", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        hot = hot_keys(now.groupBy("root").agg(F.count("*").alias("n")), "root")
        after = checkpointed(spread_join(now, on, "root", hot, F.col("id"), "left"))
        if after.where("next is not null").isEmpty():
            return now
        now = checkpointed(after.select("id", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) per word of the vocabulary of ``docs``."""
    words = vocabulary(docs, id_col, text_col)
    near = words.join(neighbours(words), "id", "left")
    near = checkpointed(near.withColumn("form", F.when(F.col("form_n") >= FACTOR * F.col("n"), F.col("form"))).withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n"))))
    ends = near.join(_roots(near.where("form is not null").select("id", "form")), "id", "left")
    called = words.select(F.col("id").alias("other"), F.col("word").alias("called"))
    for column in ("form", "root"):
        hot = hot_keys(ends.where(f"{column} is not null").groupBy(F.col(column).alias("other")).agg(F.count("*").alias("k")), "other", "k")
        some = spread_join(ends.where(f"{column} is not null").withColumnRenamed(column, "other"), called, "other", hot, F.col("id")).drop("other").withColumnRenamed("called", column)
        ends = some.unionByName(ends.where(f"{column} is null").withColumn(column, F.lit(None).cast("string")))
    return ends.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


ORACLE_SQL = """
WITH RECURSIVE steps AS (
    SELECT range AS i, 0 AS k, range::UBIGINT AS c FROM range(256)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8
), bytes AS (
    SELECT list(c ORDER BY i) AS crc FROM steps WHERE k = 8
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL
), counted AS (
    SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_transform(range(octet_length(encode(doc_id || ':' || run)) + 1), lambda j: CASE WHEN j = 0 THEN 4294967295::UBIGINT
        ELSE ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * j - 1, 2))::UBIGINT END), lambda s, b: xor(s >> 8, crc[((xor(s, b) & 255) + 1)::BIGINT]))) AS h
    FROM counted, bytes
), words AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1
), vocabulary AS (
    SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2
), places AS (
    SELECT word, n, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), near AS (
    SELECT a.word, b.word AS other FROM places a JOIN places b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT a.word, b.word FROM places a JOIN vocabulary b ON a.head || a.tail = b.word
    UNION SELECT b.word, a.word FROM places a JOIN vocabulary b ON a.head || a.tail = b.word
), best AS (
    SELECT v.word, v.n, count(near.other) AS n_near, first(o.word ORDER BY o.n DESC, encode(o.word)) AS other, first(o.n ORDER BY o.n DESC, encode(o.word)) AS other_n
    FROM vocabulary v LEFT JOIN near ON near.word = v.word LEFT JOIN vocabulary o ON o.word = near.other GROUP BY v.word, v.n
), formed AS (
    SELECT word, n, n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM best
), ways AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL
    SELECT ways.word, f.word, f.form FROM ways JOIN formed f ON f.word = ways.next
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM ways WHERE next IS NULL) USING (word)
"""
