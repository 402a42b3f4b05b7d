"""The observer of growing logs: each batch of lines begins where the one before ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.operators import logs


def state(spark: SparkSession, folder: str, source_type: str, below: int | None = None) -> DataFrame:
    """(source, ``logs.CARRIED``) that the newest observation of each source left, of those of batches before ``below`` if given."""
    own = spark.createDataFrame([], f"source {source_type}, {logs.CARRIED}").schema
    if below == 0:
        return spark.createDataFrame([], own)
    rows = spark.read.schema(StructType([*own, StructField("batch", IntegerType())])).option("basePath", f"{folder}/carried").parquet(f"{folder}/carried")
    if below is not None:
        rows = rows.where(F.col("batch") < below)
    columns = [c for c in own.names if c != "source"]
    return rows.groupBy("source").agg(F.max_by(F.struct(*columns), "batch").alias("row")).select("source", "row.*")


def observer(folder: str, since: str | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """``logs.observed`` as the work of a loop (``poll``) over (source, seq, line): a summary per source and batch.

    What a batch leaves is kept under its number, of the sources in it only, so a
    batch that is run again begins as it did the first time.
    """

    def work(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        kind = batch.schema["source"].dataType.simpleString()
        found, left = logs.observed(batch, state(spark, folder, kind, number), since)
        here = batch.select(F.col("source").alias("_here")).distinct()
        left.join(here, F.col("source").eqNullSafe(F.col("_here")), "left_semi").write.mode("overwrite").parquet(f"{folder}/carried/batch={number}")
        return found

    return work
