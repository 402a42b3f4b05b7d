"""Lookups that spread hot keys over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
HOT_KEYS, HOT_ROWS = 1000, 10_000


def lookup(many: DataFrame, one: DataFrame, key: str, spread: Column, rows: str = "rows_") -> DataFrame:
    """``many`` with the row of ``one`` for its key, if there is one; a null key finds nothing.

    ``one`` has a row a key and in ``rows`` how many rows of ``many`` have that key. The
    ``HOT_KEYS`` largest of ``HOT_ROWS`` rows or more are dealt to ``SALTS`` tasks by
    ``spread``; their names are all that is broadcast. Any other key has less than one in
    ``HOT_KEYS`` of all rows.
    """
    hot = one.where(F.col(rows) >= HOT_ROWS).orderBy(F.col(rows).desc(), key).limit(HOT_KEYS).select(F.col(key).alias("hot_"))
    marked = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("hot_"), "left")
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    salted = marked(many).withColumn("salt_", F.when(F.col("hot_").isNotNull(), salt).otherwise(0)).drop("hot_")
    every = F.when(F.col("hot_").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = salted.where(F.col(key).isNotNull()).join(marked(one.drop(rows)).withColumn("salt_", F.explode(every)).drop("hot_"), [key, "salt_"], "left")
    # rows without a key have nothing to meet: they stay where they are
    bare = salted.where(F.col(key).isNull())
    return found.drop("salt_").unionByName(bare.drop("salt_"), allowMissingColumns=True)
