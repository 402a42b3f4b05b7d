"""Readers of the collections."""

from pyspark.sql import DataFrame, SparkSession

from quire.sources.tail import log_lines, log_tail

__all__ = ["log_lines", "log_tail", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
