"""Event-log compaction and de-noising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT_LIMIT = 500


def keep_latest(events: DataFrame, task: str, at: str, key: str, n: int) -> DataFrame:
    """The newest ``n`` events of each task; events without a task share one group."""
    newest = Window.partitionBy(F.coalesce(F.col(task).cast("string"), F.lit("_global"))).orderBy(F.col(at).desc(), F.col(key).desc())
    return events.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def first_of_kind(events: DataFrame, task: str, kind: str, value: str, at: str, key: str) -> DataFrame:
    """Of each task's events of one kind the earliest stays; other events are left alone."""
    is_kind = F.coalesce(F.col(kind) == value, F.lit(False))
    nth = F.row_number().over(Window.partitionBy(task, is_kind).orderBy(at, key))
    return events.withColumn("_nth", nth).where(~is_kind | (F.col("_nth") == 1)).drop("_nth")


def changes_only(events: DataFrame, task: str, at: str, key: str, parts: list[Column]) -> DataFrame:
    """Events whose semantic key differs from the one before in their task."""
    meaning = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    before = F.lag("_meaning").over(Window.partitionBy(task).orderBy(at, key))
    return events.withColumn("_meaning", meaning).withColumn("_before", before).where(~F.col("_meaning").eqNullSafe(F.col("_before"))).drop("_meaning", "_before")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int, newest: list[Column]) -> DataFrame:
    """The last row of each key, of these the newest ``n``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth").orderBy(*newest).limit(n)


def slim(payload: Column, limit: int, keep: tuple[str, ...]) -> dict[str, Column]:
    """JSON payloads over ``limit`` characters cut down to a white list of short texts, and whether that happened."""
    long = F.length(payload) > limit
    short = F.to_json(F.struct(*(F.left(F.get_json_object(payload, f"$.{k}"), F.lit(TEXT_LIMIT)).alias(k) for k in keep)))
    return {"payload": F.when(long, short).otherwise(payload), "truncated": F.coalesce(long, F.lit(False))}


#: What a slimmed historic payload keeps, besides what it takes out of its metadata.
OLD_LIMIT = 8192
FROM_METADATA = ("parsedFilesCount", "parsedPrefix", "artifactManifestObjectName", "mineruTaskId")
KEPT = ("state", "stage", "progress")
CUT_TEXTS = ("message", "error", "errorMessage")


def slim_historic(payload: Column) -> dict[str, Column]:
    """The start-up form of ``slim``: payloads that are long or carry metadata or parsed artifacts keep a few keys, some taken out of the metadata."""
    at = lambda path: F.get_json_object(payload, f"$.{path}")
    heavy = (F.length(payload) > OLD_LIMIT) | at("metadata").isNotNull() | at("parsedArtifacts").isNotNull()
    falsy = lambda c: c.isNull() | c.isin("", "0", "false")
    parts = [F.when(falsy(at(k)), at(f"metadata.{k}")).otherwise(at(k)).alias(k) for k in FROM_METADATA] + [at(k).alias(k) for k in KEPT] + [F.left(at(k), F.lit(TEXT_LIMIT)).alias(k) for k in CUT_TEXTS]
    return {"payload": F.when(heavy, F.to_json(F.struct(*parts))).otherwise(payload), "slimmed": F.coalesce(heavy, F.lit(False))}
