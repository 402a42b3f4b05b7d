"""State a key on Spark's state store: last meaning of a task, newest entries of a stream."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def _place(row) -> tuple:
    """Orders rows that begin with time and key by these, nulls first; a null is never compared with a value."""
    return row[0] is not None, row[0], row[1] is not None, row[1]


class _Changes(StatefulProcessor):
    """Keeps one text a task, the meaning seen last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "meaning string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.exists()
        before = self.last.get()[0] if known else None
        out = []
        for at, event, task, meaning in sorted(((r["at"], r["key"], r["task"], r["meaning"]) for r in rows), key=_place):
            if not known or meaning != before:
                out.append(Row(task=task, at=at, key=event))
            known, before = True, meaning
        if out:  # else the state is what it was
            self.last.update((before,))
        return iter(out)

    def close(self) -> None:
        pass


def changes_only(stream: DataFrame, task: str, at: str, key: str, meaning: Column) -> DataFrame:
    """The stream of events (task, at, key) whose meaning differs from the last one of their task.

    Within a micro-batch events are taken in the order of time and key, nulls first;
    what arrives late is compared with what was seen last. The first event of a task
    counts as a change; null is a meaning. A batch writes the state of the tasks that
    changed in it and of no other. The events of one task in one batch meet in one
    task of Spark, so the source's limit on a batch bounds what is held.
    """
    slim = stream.select(F.col(task).alias("task"), F.col(at).alias("at"), F.col(key).alias("key"), meaning.cast("string").alias("meaning"))
    schema = StructType([slim.schema[c] for c in ("task", "at", "key")])
    return slim.groupBy("task").transformWithState(_Changes(), schema, "append", "None")


class _Newest(StatefulProcessor):
    """Keeps the newest entries of a stream."""

    def __init__(self, n: int, entry: StructType):
        self.n, self.entry = n, entry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.entry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.entry.names
        old = [tuple(x) for x in self.kept.get()] if self.kept.exists() else []
        new = heapq.nlargest(self.n, (tuple(row[c] for c in names) for row in rows), key=_place)
        self.kept.put(heapq.nlargest(self.n, old + new, key=_place))
        return iter([])

    def close(self) -> None:
        pass


def newest(stream: DataFrame, group: str, at: str, key: str, columns: list[str], n: int = 500) -> DataFrame:
    """A stream that keeps the ``n`` newest entries (by ``at`` and ``key``, nulls are oldest) of each group in its state and gives nothing; to be run by ``keep_state``, read by ``recent``.

    What is held of a group, in state and in memory, are ``2 n`` entries however many come.
    """
    rest = [c for c in columns if c not in (at, key)]
    slim = stream.select(F.col(group).alias("stream"), F.col(at).alias("at"), F.col(key).alias("key"), *rest)
    entry = StructType([slim.schema[c] for c in ("at", "key", *rest)])
    return slim.groupBy("stream").transformWithState(_Newest(n, entry), StructType([slim.schema["stream"]]), "update", "None")


def recent(spark: SparkSession, folder: str, since=None, limit: int | None = None) -> DataFrame:
    """(stream, at, key, ...) kept by ``newest``, those after ``since``, of each stream the ``limit`` newest, read from the state."""
    state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{folder}/state")
    rows = state.select(F.col("key.stream").alias("stream"), F.col("list_element.*"))
    if since is not None:
        rows = rows.where(F.col("at") > F.lit(since))
    if limit is None:
        return rows
    place = F.struct("at", "key")
    # a stream has a bounded number of entries
    best = rows.groupBy("stream").agg(F.sort_array(F.collect_list(place), asc=False).alias("all")).select("stream", F.explode(F.slice("all", 1, max(1, limit))).alias("place"))
    return rows.withColumn("place", place).join(best, ["stream", "place"], "left_semi").drop("place")
