"""Controlled classification against a taxonomy table (kind, name, ordinal, id, zh, en, aliases)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import truthy

#: Facets, domains outside education, and what those take away.
FACETS = ("domain", "collection", "curriculum", "stage", "level", "subject", "resource_type", "component_role")
NON_EDUCATION = ("06_公司行政经营资料", "99_待识别与低置信度")
EDUCATION_FACETS = ("collection", "curriculum", "stage", "level", "subject")


def keys(taxonomy: DataFrame) -> DataFrame:
    """One row per key of an entry: its id as it is, names and aliases in lower case; the first entry of a key wins."""
    every = F.concat(F.array("id"), F.transform(F.concat(F.array("zh", "en"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(x)))
    rows = taxonomy.select("kind", "name", "ordinal", "id", "zh", "en", F.explode(F.array_distinct(every)).alias("key"))
    first = Window.partitionBy("kind", "name", "key").orderBy("ordinal")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("kind", "name", "key", "id", "zh", "en")


def lookup(raw: DataFrame, taxonomy: DataFrame, kind: str) -> DataFrame:
    """``raw`` (name, value, …) with the entry that each value names; the join strategy follows the taxonomy's size."""
    own = keys(taxonomy).where(F.col("kind") == kind).drop("kind")
    return raw.withColumn("key", F.lower(F.trim("value"))).join(own, ["name", "key"], "left")


def facets(raw: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Per document: matched and unmatched facets and the reasons to review them."""
    found = lookup(raw.where(truthy(F.trim("value")) & F.col("name").isin(*FACETS)), taxonomy, "facet")
    outside = F.max((F.col("name") == "domain") & F.coalesce(F.col("id").isin(*NON_EDUCATION), F.lit(False))).over(Window.partitionBy("doc_id"))
    found = found.withColumn("outside", outside)
    moved = F.col("outside") & F.col("id").isNotNull() & F.col("name").isin(*EDUCATION_FACETS)
    found = found.withColumn("matched", F.col("id").isNotNull() & ~moved)
    pairs = lambda cond, value: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.concat_ws("=", "name", value)))), ";")
    lost = ~F.col("matched")
    core = F.max(lost & F.col("name").isin("domain", "subject"))
    reasons = F.concat(F.collect_list(F.when(lost, F.concat(F.lit("unmatched_"), "name"))), F.array_compact(F.array(F.when(F.max("outside"), "non_education_domain"), F.when(core, "unmatched_core_facets"))))
    return found.groupBy("doc_id").agg(
        pairs(F.col("matched"), F.col("id")).alias("controlled"), pairs(lost, F.when(F.col("id").isNull(), F.col("value")).otherwise(F.col("zh"))).alias("unmatched"), F.array_join(F.array_sort(reasons), ";").alias("reasons")
    )


def tags(raw: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Per document: distinct matched tag ids and distinct proposals of 2 to 29 characters."""
    found = lookup(raw.where(truthy(F.trim("value"))), taxonomy, "tag")
    new = F.col("id").isNull() & F.length(F.trim("value")).between(2, 29)
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return found.groupBy("doc_id").agg(text(F.col("id")).alias("matched"), text(F.when(new, F.trim("value"))).alias("proposed"))


def final_state(reasons: Column, proposed: Column) -> Column:
    return F.when(truthy(reasons) | truthy(proposed), "review-pending").otherwise("confirmed")
