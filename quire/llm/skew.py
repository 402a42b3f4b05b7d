"""Joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
HOT_KEYS = 1000
HOT_ROWS = 2_000


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> list:
    """The largest keys of (key, n), at most ``HOT_KEYS``, of ``HOT_ROWS`` or more. Any other key has less than a thousandth of all rows."""
    return [r[0] for r in counts.where(F.col(n) >= HOT_ROWS).select(key, n).orderBy(F.col(n).desc(), key).limit(HOT_KEYS).collect()]


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: list, spread: Column, how: str = "inner") -> DataFrame:
    """``many`` joined with at most one row per key of ``one``; rows of the hot keys are dealt to ``SALTS`` tasks by ``spread``.

    Only the names of hot keys are broadcast, at most ``HOT_KEYS`` of them.
    """
    if not hot:
        return many.join(one, key, how)
    kind = many.schema[key].dataType
    hot = many.sparkSession.createDataFrame([(k,) for k in hot], f"`{key}` {kind.simpleString()}").withColumn("hot_", F.lit(True))
    salted = many.join(F.broadcast(hot), key, "left").withColumn("salt_", F.when(F.col("hot_"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot_")
    every = one.join(F.broadcast(hot), key, "left").withColumn("salt_", F.explode(F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot_")
    return salted.join(every, [key, "salt_"], how).drop("salt_")
