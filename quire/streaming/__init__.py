"""Structured Streaming forms of the event operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.streaming.folders import shared_folder

#: Files of a micro-batch.
BATCH_FILES = 64
#: State on disk, of which a batch writes only what it changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_events(spark: SparkSession, path: str, files: int = BATCH_FILES) -> DataFrame:
    """Events as a stream of Parquet files, with the schema of those that are there; a pattern also takes a single file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


class Replay:
    """A table that comes in steps: each writes the rows of its number ``nth`` (from 0) to a folder in the shared one, whose ``stream`` is run after it."""

    def __init__(self, rows: DataFrame, nth: Column, parts: int):
        self.rows, self.nth, self.parts = rows, nth, parts
        self.folder = f"{shared_folder(rows.sparkSession)}/replay-{uuid.uuid4().hex}"

    def stream(self) -> DataFrame:
        return self.rows.sparkSession.readStream.schema(self.rows.schema).parquet(self.folder)

    def steps(self) -> Iterator[int]:
        for k in range(self.parts):
            self.rows.where(self.nth == k).write.mode("append").parquet(self.folder)
            yield k


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """What starts inside keeps its state by ``STATE``; a query takes these settings along when it starts."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_folder(spark: SparkSession) -> str:
    """A folder for a stream of its own."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_now(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Everything that is there now, through a file sink in the shared folder; with the ``folder`` of an earlier run what came since."""
    spark = stream.sparkSession
    base = folder or new_folder(spark)
    with _state_store(spark):
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def keep_state(stream: DataFrame, folder: str) -> StreamingQuery:
    """Runs a stream that only keeps state to the end of what is there; the finished query."""
    with _state_store(stream.sparkSession):
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def poll(stream: DataFrame, work: Callable[[DataFrame, int], DataFrame], folder: str, seconds: float | None = None) -> StreamingQuery:
    """A loop that takes what has come every ``seconds`` (None: what is there now, then it ends) and keeps what ``work`` makes of each batch.

    Batches are numbered, and a batch that is run again after a failure overwrites
    the folder of its number, so nothing is written twice and nothing is missed.
    How much a batch takes is the source's limit (``read_events``).
    """

    def step(batch: DataFrame, number: int) -> None:
        work(batch, number).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state")
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    with _state_store(stream.sparkSession):
        return writer.start()


def polled(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What a loop has kept so far, with the number of the batch."""
    return spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
