"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, target: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``limit`` labelled documents, chosen by a hash of the id.

    Labels other than 0 and 1 are ignored; of several labels of an id the
    smallest holds, of several texts the first in order. The ids are limited before the join, so what is broadcast
    has at most ``limit`` rows.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(target).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
