"""Event streams: task filter, attribution, deduplication, compaction. State a key of our own is in ``stateful``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.operators import events
from quire.streaming import polled


def of_task(stream: DataFrame, task: str, value) -> DataFrame:
    return stream.where(F.col(task) == value)


def attributed(stream: DataFrame, tasks: DataFrame, task: str, at: str) -> DataFrame:
    """Observations joined to their task, unless they are older than its start."""
    return stream.join(tasks, task).where(F.col(at) >= F.col("started_at"))


def attributed_late(observations: DataFrame, starts: DataFrame, task: str, at: str, started: str, late: str, longest: str) -> DataFrame:
    """Both as streams: observations joined to the starts of their task, whichever comes first, unless they are older.

    Either may come up to ``late`` after the latest of its stream, and a task takes
    observations for ``longest`` after its start, so both sides end: a start is
    forgotten when no observation of it can come any more, an observation when its
    start cannot. Times are timestamps; what comes later than that, or has no time, is
    not joined.
    """
    seen = observations.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    begun = starts.select(F.col(task).alias("_task"), F.col(started).alias("started_at"), F.col(started).cast("timestamp").alias("_from")).withWatermark("_from", late)
    on = (F.col(task) == F.col("_task")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_from") + F.expr(f"INTERVAL {longest}"))
    return seen.join(begun, on).drop("_at", "_task", "_from")


def single_owner(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each observation of a batch with its source's task if exactly one is eligible, else without; for foreachBatch."""
    only = tasks.groupBy("source").agg(F.count("*").alias("n"), F.min("task").alias("task"))
    return rows.join(only, "source", "left").withColumn("task", F.when(F.col("n") == 1, F.col("task"))).drop("n")


def judged(rows: DataFrame, eligible: DataFrame, at: str, level: str) -> DataFrame:
    """Observations with the task they go to, or why to none: only if exactly one task of their source is eligible and they are not older than its start; noise goes to none.

    ``eligible`` has (source, task, started_at). The reasons come in this order.
    """
    only = eligible.groupBy("source").agg(F.count("*").alias("_n"), F.min("task").alias("_task"), F.min("started_at").alias("_from"))
    old = F.coalesce(F.col(at) < F.col("_from"), F.lit(False))
    reason = F.when(F.coalesce(F.col("_n") != 1, F.lit(True)), "unattributed").when(old, "stale").when(F.col(level) == "api-alive-only", "api-noise")
    found = rows.join(only, "source", "left").withColumn("attribution", F.coalesce(reason, F.lit("attributed")))
    return found.withColumn("task", F.when(F.col("attribution") == "attributed", F.col("_task"))).drop("_n", "_task", "_from")


def attribution(snapshot: Callable[[int], DataFrame], folder: str, at: str, level: str) -> Callable[[DataFrame, int], DataFrame]:
    """``judged`` as the work of a loop (``poll``): each batch counts the tasks eligible when it runs.

    ``snapshot`` gives them; what it gave is kept under the batch's number, so a batch
    that is run again judges as it did the first time.
    """

    def work(batch: DataFrame, number: int) -> DataFrame:
        spark, path = batch.sparkSession, f"{folder}/eligible/batch={number}"
        try:
            known = spark.read.parquet(path)
        except AnalysisException as missing:
            if not {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"} & {missing.getCondition()}:
                raise
            snapshot(number).write.mode("overwrite").parquet(path)
            known = spark.read.parquet(path)
        return judged(batch, known, at, level)

    return work


def once(stream: DataFrame, key: str) -> DataFrame:
    """The first event of each key, for ever: the state has every key that ever came."""
    return stream.dropDuplicates([key])


def once_within(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first event of each key by ``at``, and no other that comes within ``late`` of it.

    A key is forgotten once the watermark, the latest ``at`` of the batches before less
    ``late``, has passed its first event by ``late``: a repeat after that counts as new,
    one that is itself older than the watermark is dropped. So the state has the keys
    of twice ``late``, not those of all times.
    """
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def compaction(folder: str, columns: DataFrame, task: str, at: str, key: str, n: int) -> Callable[[DataFrame, int], DataFrame]:
    """``compact`` as the work of a loop (``poll``) over the same folder: batch by batch the newest ``n`` events of each task that came in it.

    Only the tasks of the batch are read back and written; ``compacted`` takes the
    newest version of each task. Versions of earlier batches are the input of later
    ones, so a batch that is run again finds what it found the first time.
    """

    def work(batch: DataFrame, number: int) -> DataFrame:
        named = batch.select(F.coalesce(F.col(task).cast("string"), F.lit("_global")).alias("_group")).distinct()
        stored = compacted(batch.sparkSession, folder, columns, task, below=number) if number else columns.limit(0)
        group = F.coalesce(F.col(task).cast("string"), F.lit("_global"))
        own = stored.withColumn("_group", group).join(named, "_group", "left_semi").drop("_group")
        return compact(own, batch.select(*columns.columns), task, at, key, n)

    return work


def compacted(spark: SparkSession, folder: str, columns: DataFrame, task: str, below: int | None = None) -> DataFrame:
    """What ``compaction`` has kept: the rows of each task's newest version, of those of batches before ``below`` if given."""
    rows = polled(spark, folder, StructType([*columns.schema, StructField("batch", IntegerType())]))
    if below is not None:
        rows = rows.where(F.col("batch") < below)
    rows = rows.withColumn("_group", F.coalesce(F.col(task).cast("string"), F.lit("_global")))
    newest = rows.groupBy("_group").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["_group", "batch"], "left_semi").select(*columns.columns)


def compact(stored: DataFrame, batch: DataFrame, task: str, at: str, key: str, n: int) -> DataFrame:
    """The next version of the event table after a batch: the newest ``n`` of each task; for foreachBatch."""
    return events.keep_latest(stored.unionByName(batch).dropDuplicates([key]), task, at, key, n)


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines of each source."""
    last = Window.partitionBy("source").orderBy(F.col("seq").desc())
    return lines.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")
