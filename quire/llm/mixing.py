"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order, null last, weigh 5, 2, 1, repeating, and share the
words of the corpus; no target passes three times its source, and what a capped
source cannot use is shared out again by weight. A source first gives complete
epochs. For the fractional rest each document draws the key -ln(u) / w, where u
is a hash of its id and w its quality weight; documents are taken by rising key
until the words left are used up, the last one in part.

The running totals behind that cut never put a source into one task: keys fall
into 256 ranges per source, whose sums find the range that holds the cut; that
range is split once more into 256; only the rows of the final range, about one
in 65,536, are ordered one by one.

Defined results: a null text has no words; documents without words take none; a
null doc_id draws its key as the text ``null``; equal keys are taken by smaller
doc_id; of rows that agree in everything an arbitrary one is cut; a text is
counted whole, however long. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.recovery import checkpointed

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
RANGES = 256


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.1 and 1, less for texts with many markup symbols per word."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>!]")), F.lit(0))
    return F.when(size > 0, F.greatest(F.lit(0.1), 1 - symbols.cast("double") / size.cast("double"))).otherwise(F.lit(1.0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the shares by weight with what is above the cap shared again.

    Sources in the order of cap over weight reach their caps in that order, so
    the level lambda at which the shares meet the total follows from running
    sums; one row per source is all that this handles.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    named = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    named = named.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "before": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rest": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
            "place": F.row_number().over(by),
        }
    )
    level = (F.col("total") - F.col("before")) / F.col("rest")
    named = named.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    named = named.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("place"))).over(everything))
    return named.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _cut(rows: DataFrame, bin_col: str, rest: str, at: str, before: str) -> DataFrame:
    """Per source the range in which the running size passes ``rest``, and the size before it."""
    sums = rows.groupBy("source", bin_col).agg(F.sum("size").alias("s"), F.max(rest).alias("r"))
    upto = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("b", upto).where("b < r and r <= b + s").select("source", F.col(bin_col).alias(at), F.col("b").alias(before))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), and the columns in ``carry``."""
    carried = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    slim = docs.select(*carried, F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.col(text_col).alias("text"))
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    slim = checkpointed(slim.select(*(f"carried_{i}" for i in range(len(carry))), "id", "source", "size", (-F.log(u) / quality_weight(F.col("text"), F.col("size"))).alias("key")))
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    quota = F.least(F.round("target").cast("long"), most * F.col("source_size"))
    plan = plan.withColumn("quota", quota).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0))
    plan = checkpointed(plan.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_size")))
    spot = (1 - F.exp(-F.col("key") / 2)) * RANGES
    rows = slim.withColumn("wide", F.least(F.floor(spot), F.lit(RANGES - 1)).cast("int")).withColumn("fine", F.least(F.floor((spot - F.floor(spot)) * RANGES), F.lit(RANGES - 1)).cast("int"))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    wide = _cut(rows, "wide", "rest", "at_wide", "before_wide")
    first = rows.join(wide.withColumnRenamed("source", "s1"), rows["source"].eqNullSafe(F.col("s1")), "left").drop("s1")
    inner = first.where("wide = at_wide").withColumn("left_over", F.col("rest") - F.col("before_wide"))
    fine = checkpointed(_cut(inner, "fine", "left_over", "at_fine", "before_fine"))
    both = first.join(fine.withColumnRenamed("source", "s2"), first["source"].eqNullSafe(F.col("s2")), "left").drop("s2")
    edge = (F.col("wide") == F.col("at_wide")) & (F.col("fine") == F.col("at_fine"))
    edge = F.coalesce(edge, F.lit(False))
    upto = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.col("rest") - F.col("before_wide") - F.col("before_fine") - upto
    last = both.where(edge).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    ahead = (F.col("wide") < F.col("at_wide")) | ((F.col("wide") == F.col("at_wide")) & (F.col("fine") < F.col("at_fine")))
    clear = both.where(~edge).withColumn("part", F.when(ahead, F.col("size")).otherwise(0))
    return last.unionByName(clear).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)))


def _row_hash(docs: DataFrame) -> Column:
    """A hash over all columns of a row; maps and variants by their JSON text."""
    hashed = [F.to_json(F.struct(f.name)) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f.name) for f in docs.schema]
    return F.xxhash64(*hashed)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """The mix itself: each document as often as it is taken whole, the last one of a source cut to its first words.

    Rows are rows: those that agree in some columns only are mixed each for
    itself. Rows that agree in every column cannot be told apart; they are emitted
    together as often as their shares ask for. A cut text has single spaces.
    """
    # columns are renamed by position, so that no name of the table can clash
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = {c: names[i] for i, c in enumerate(docs.columns)}
    text = own[text_col]
    marked = docs.toDF(*names)
    marked = marked.withColumn("row", _row_hash(marked))
    shares = mix(marked, own[id_col], text, own[source_col], carry=("row",)).where("taken > 0")
    shares = shares.groupBy(F.col(own[id_col]).alias("k_id"), F.col("row").alias("k_row")).agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("times"))
    shares = checkpointed(shares)
    same = marked[own[id_col]].cast("long").eqNullSafe(shares["k_id"]) & (marked["row"] == shares["k_row"])
    joined = marked.join(shares, same)
    if not shares.where("times > 1").isEmpty():
        # of equal rows one stands for all; partial sums keep them apart from each other's tasks
        first = [F.any_value(c).alias(c) for c in names]
        joined = joined.where("times = 1").select(*names, "taken", "size").unionByName(joined.where("times > 1").groupBy("row", "k_id", "taken", "size").agg(*first).select(*names, "taken", "size"))
    whole = F.expr("CASE WHEN taken >= size THEN sequence(1L, taken div size) ELSE array() END")
    part = F.col("taken") % F.col("size")
    pieces = joined.withColumn("words", F.explode(F.concat(F.transform(whole, lambda _: F.lit(0).cast("long")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))))
    split = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pieces = pieces.withColumn("cut", F.when(F.col("words") > 0, F.array_join(F.slice(split, F.lit(1), F.col("words").cast("int")), " ")))
    out = {text: F.coalesce("cut", text)}
    if length_col in own:
        out[own[length_col]] = F.when(F.col("words") > 0, F.char_length("cut")).otherwise(F.col(own[length_col])).cast(docs.schema[length_col].dataType)
    return pieces.select(*(out[c].alias(c) if c in out else F.col(c) for c in names)).toDF(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]')) AS symbols,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / CASE WHEN size > 0 THEN greatest(0.1::DOUBLE, 1 - symbols::DOUBLE / size::DOUBLE) ELSE 1.0 END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total,
        coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
        (sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest,
        row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT min_by((total - before) / rest, place) AS level FROM r WHERE (total - before) / rest <= cap::DOUBLE / weight),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM r, l),
q AS (SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS quota FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS epochs FROM q),
p AS (SELECT k.*, e.source_size, e.target, e.epochs, e.quota - e.epochs * e.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""
