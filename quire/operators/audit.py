"""Consistency audit: each rule is a frame of findings, the audit the findings of all rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import blank
from quire.operators.status import CANONICAL_JOB_STATES, CANONICAL_TASK_STATES


DONE = ("completed", "review-pending")


def _found(when: Column, no: int, kind: str, severity: str, target: str, key: str = "id", repair: Column | None = None) -> Column:
    """A finding where ``when`` holds, else null."""
    repair = F.lit(None).cast("string") if repair is None else repair
    return F.when(when, F.struct(F.lit(no).alias("rule_no"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(target).alias("target_type"), F.col(key).alias("target_id"), repair.alias("repair")))


def _findings(rows: DataFrame, *found: Column) -> DataFrame:
    return rows.select(F.inline(F.array_compact(F.array(*found))))


def _flagged(rows: DataFrame, key: str, known: DataFrame, flag: str, blanks: bool = False) -> DataFrame:
    """Rows with ``flag`` true where ``key`` is among the first column of ``known``, else null; no row is repeated.

    Rows with a null or, unless ``blanks`` count as keys, an empty key find nothing, so
    instead of meeting in one task they are dealt out by names that no key has.
    """
    none = F.col(key).isNull() if blanks else blank(F.col(key))
    keys = known.select(F.col(known.columns[0]).alias("key_")).where("key_ is not null").distinct().withColumn(flag, F.lit(True))
    dealt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*rows.columns), F.lit(1024)).cast("string"))
    return rows.withColumn("key_", F.when(none, dealt).otherwise(F.col(key))).join(keys, "key_", "left").drop("key_")


def _lacks(key: str, flag: str) -> Column:
    return ~blank(F.col(key)) & F.col(flag).isNull()


def _bad_state(states: tuple[str, ...], kind: str, target: str, repair: Column | None = None) -> Column:
    return _found(~blank(F.col("state")) & ~F.col("state").isin(*states), 1, kind, "warn", target, repair=repair)


def _bad_task_state() -> Column:
    return _bad_state(CANONICAL_TASK_STATES, "non-canonical-task-state", "ParseTask")


def _bad_job_state() -> Column:
    return _bad_state(CANONICAL_JOB_STATES, "non-canonical-ai-state", "AiMetadataJob", F.when(F.col("state") == "succeeded", "PATCH confirmed"))


def _orphan_task() -> Column:
    repair = F.when(F.col("state").isin(*DONE), "PATCH canceled").when(F.col("state") == "failed", "DELETE").otherwise("PATCH failed")
    return _found(_lacks("material_id", "_material"), 2, "orphan-task", "error", "ParseTask", repair=repair)


def _orphan_job() -> Column:
    return _found(_lacks("parse_task_id", "_task"), 3, "orphan-ai-job", "error", "AiMetadataJob", repair=F.when(F.col("state") == "failed", "DELETE").otherwise("PATCH failed"))


def _dangling_job() -> Column:
    return _found(_lacks("ai_job_id", "_job"), 4, "dangling-material-ai-job", "warn", "Material", repair=F.lit("PATCH pending"))


def _idle_task() -> Column:
    return _found((F.col("state") == "ai-running") & F.col("_live").isNull(), 5, "ai-running-without-active-job", "warn", "ParseTask", repair=F.lit("PATCH ai-pending"))


def _bad_prefix() -> tuple[Column, Column]:
    off = lambda c, top: ~blank(F.col(c)) & ~F.col(c).startswith(F.concat(F.lit(top), "id", F.lit("/")))
    return _found(off("object_name", "originals/"), 6, "bad-original-prefix", "info", "Material"), _found(off("markdown_object_name", "parsed/"), 6, "bad-parsed-prefix", "info", "Material")


def _lost_files() -> tuple[Column, Column]:
    """Of materials: the original is gone and no finished task will tell, the parsed file is gone."""
    original = _lacks("object_name", "_raw") & ~F.coalesce("_done", F.lit(False))
    return (
        _found(original, 7, "original-file-missing", "error", "Material", repair=F.lit("DELETE")),
        _found(_lacks("markdown_object_name", "_parsed"), 7, "parsed-file-missing", "warn", "Material", repair=F.when(F.col("_complete"), "PATCH canceled")),
    )


def _lost_original() -> Column:
    """Of finished tasks: the original of their material is gone."""
    return _found(F.col("state").isin(*DONE) & F.col("_lost"), 7, "original-file-missing-with-completed-task", "error", "ParseTask", repair=F.lit("PATCH canceled"))


def _names(objects: DataFrame, bucket: str) -> DataFrame:
    return objects.where(F.col("bucket") == bucket).select("name")


def _live(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("state").isin("pending", "running")).select("parse_task_id")


def _with_files(materials: DataFrame, tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """Materials with what is known of their files and of their finished tasks."""
    done = tasks.where(F.col("state").isin(*DONE)).groupBy(F.col("material_id").alias("id")).agg(F.lit(True).alias("_done"), F.bool_or(F.col("state") == "completed").alias("_complete"))
    rows = _flagged(materials, "object_name", _names(objects, "raw"), "_raw")
    return _flagged(rows, "markdown_object_name", _names(objects, "parsed"), "_parsed").join(done, "id", "left")


def _with_material(tasks: DataFrame, materials: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Tasks that know whether their material exists and, given the objects, whether its original is gone."""
    lost = F.lit(False)
    if objects is not None:
        materials, lost = _flagged(materials.select("id", "object_name"), "object_name", _names(objects, "raw"), "_raw"), _lacks("object_name", "_raw")
    known = materials.groupBy(F.col("id").alias("material_id")).agg(F.lit(True).alias("_material"), F.bool_or(lost).alias("_lost"))
    return tasks.join(known, "material_id", "left")


def task_states(tasks: DataFrame) -> DataFrame:
    return _findings(tasks, _bad_task_state())


def job_states(jobs: DataFrame) -> DataFrame:
    return _findings(jobs, _bad_job_state())


def orphan_tasks(tasks: DataFrame, materials: DataFrame) -> DataFrame:
    """Tasks of materials that do not exist: finished ones lose their resource, failed ones go, the rest fail."""
    return _findings(_with_material(tasks, materials), _orphan_task())


def orphan_jobs(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    return _findings(_flagged(jobs, "parse_task_id", tasks.select("id"), "_task"), _orphan_job())


def dangling_jobs(materials: DataFrame, jobs: DataFrame) -> DataFrame:
    return _findings(_flagged(materials, "ai_job_id", jobs.select("id"), "_job"), _dangling_job())


def idle_ai_tasks(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    return _findings(_flagged(tasks.where("state = 'ai-running'"), "id", _live(jobs), "_live", blanks=True), _idle_task())


def bad_prefixes(materials: DataFrame) -> DataFrame:
    return _findings(materials, *_bad_prefix())


def missing_files(materials: DataFrame, tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """Originals without an object: their finished tasks lose the resource, or else the material goes. Parsed files likewise."""
    done = tasks.where(F.col("state").isin(*DONE))
    return _findings(_with_files(materials, tasks, objects), *_lost_files()).unionByName(_findings(_with_material(done, materials, objects), _lost_original()))


def orphan_objects(objects: DataFrame, materials: DataFrame) -> DataFrame:
    """Objects whose second path segment names no material; without one they are orphans too."""
    owner = F.trim(F.get(F.split("name", "/"), F.lit(1)))
    return objects.withColumn("owner_id", owner).join(materials.select(F.col("id").alias("owner_id")), "owner_id", "left_anti")


def audit(materials: DataFrame, tasks: DataFrame, jobs: DataFrame, objects: DataFrame) -> DataFrame:
    """The findings of all rules. Each collection is gone through once for its rules, the others come in as keys; only the few tasks in AI are read by themselves."""
    of_tasks = _with_material(tasks, materials, objects)
    of_jobs = _flagged(jobs, "parse_task_id", tasks.select("id"), "_task")
    of_materials = _flagged(_with_files(materials, tasks, objects), "ai_job_id", jobs.select("id"), "_job")
    loose = _found(F.lit(True), 8, "orphan-object", "warn", "MinIOObject", "name", F.lit("DELETE_ORPHAN"))
    parts = [
        _findings(of_tasks, _bad_task_state(), _orphan_task(), _lost_original()),
        idle_ai_tasks(tasks, jobs),
        _findings(of_jobs, _bad_job_state(), _orphan_job()),
        _findings(of_materials, _dangling_job(), *_bad_prefix(), *_lost_files()),
        _findings(orphan_objects(objects, materials), loose),
    ]
    return reduce(DataFrame.unionByName, parts)


def distribution(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kind")
