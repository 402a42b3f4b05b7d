"""The consistency audit over the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import audit
from quire.plans.proxies import collection, with_collections

_ALL = ("materials", "tasks", "jobs", "objects")
_F = "SELECT {no} AS rule_no, '{kind}' AS kind, '{sev}' AS severity, '{target}' AS target_type, {key} AS target_id, {repair} AS repair FROM {rest}"
RULES = {
    "task_states": _F.format(no=1, kind="non-canonical-task-state", sev="warn", target="ParseTask", key="id", repair="CAST(NULL AS VARCHAR)", rest="tasks WHERE state <> '' AND state NOT IN ('uploading', 'pending', 'running', 'result-store', 'ai-pending', 'ai-running', 'review-pending', 'completed', 'failed', 'canceled')"),
    "job_states": _F.format(no=1, kind="non-canonical-ai-state", sev="warn", target="AiMetadataJob", key="id", repair="CASE WHEN state = 'succeeded' THEN 'PATCH confirmed' END", rest="jobs WHERE state <> '' AND state NOT IN ('pending', 'running', 'confirmed', 'review-pending', 'failed')"),
    "orphan_tasks": _F.format(no=2, kind="orphan-task", sev="error", target="ParseTask", key="id", repair="CASE WHEN state IN ('completed', 'review-pending') THEN 'PATCH canceled' WHEN state = 'failed' THEN 'DELETE' ELSE 'PATCH failed' END", rest="tasks WHERE material_id <> '' AND material_id NOT IN (SELECT id FROM materials)"),
    "orphan_jobs": _F.format(no=3, kind="orphan-ai-job", sev="error", target="AiMetadataJob", key="id", repair="CASE WHEN state = 'failed' THEN 'DELETE' ELSE 'PATCH failed' END", rest="jobs WHERE parse_task_id <> '' AND parse_task_id NOT IN (SELECT id FROM tasks)"),
    "dangling_jobs": _F.format(no=4, kind="dangling-material-ai-job", sev="warn", target="Material", key="id", repair="'PATCH pending'", rest="materials WHERE ai_job_id <> '' AND ai_job_id NOT IN (SELECT id FROM jobs)"),
    "idle_ai_tasks": _F.format(no=5, kind="ai-running-without-active-job", sev="warn", target="ParseTask", key="id", repair="'PATCH ai-pending'", rest="tasks t WHERE state = 'ai-running' AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.parse_task_id = t.id AND j.state IN ('pending', 'running'))"),
    "bad_prefixes": _F.format(no=6, kind="bad-original-prefix", sev="info", target="Material", key="id", repair="NULL", rest="materials WHERE object_name <> '' AND NOT starts_with(object_name, 'originals/' || id || '/')")
    + " UNION ALL "
    + _F.format(no=6, kind="bad-parsed-prefix", sev="info", target="Material", key="id", repair="NULL", rest="materials WHERE markdown_object_name <> '' AND NOT starts_with(markdown_object_name, 'parsed/' || id || '/')"),
    "missing_files": """SELECT 7 AS rule_no, CASE WHEN t.id IS NULL THEN 'original-file-missing' ELSE 'original-file-missing-with-completed-task' END AS kind, 'error' AS severity, CASE WHEN t.id IS NULL THEN 'Material' ELSE 'ParseTask' END AS target_type,
        coalesce(t.id, m.id) AS target_id, CASE WHEN t.id IS NULL THEN 'DELETE' ELSE 'PATCH canceled' END AS repair
      FROM materials m LEFT JOIN tasks t ON t.material_id = m.id AND t.state IN ('completed', 'review-pending') WHERE m.object_name <> '' AND m.object_name NOT IN (SELECT name FROM objects WHERE bucket = 'raw')
      UNION ALL SELECT 7, 'parsed-file-missing', 'warn', 'Material', m.id, CASE WHEN EXISTS (SELECT 1 FROM tasks t WHERE t.material_id = m.id AND t.state = 'completed') THEN 'PATCH canceled' END
      FROM materials m WHERE m.markdown_object_name <> '' AND m.markdown_object_name NOT IN (SELECT name FROM objects WHERE bucket = 'parsed')""",
    "orphan_objects": _F.format(no=8, kind="orphan-object", sev="warn", target="MinIOObject", key="name", repair="'DELETE_ORPHAN'", rest="objects WHERE trim(coalesce(list_extract(string_split(name, '/'), 2), '')) NOT IN (SELECT id FROM materials)"),
}
_EVERY = " UNION ALL ".join(RULES.values())


def _rule(run, *names):
    return lambda spark, sf_dir: run(*(collection(spark, sf_dir, n) for n in names))


def whole(spark, sf_dir):
    return audit.audit(*(collection(spark, sf_dir, n) for n in _ALL))


def kinds(spark, sf_dir):
    return audit.distribution(whole(spark, sf_dir))


def orphan_buckets(spark, sf_dir):
    o, m = collection(spark, sf_dir, "objects"), collection(spark, sf_dir, "materials")
    return audit.orphan_objects(o, m).rollup("bucket").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def related_ids(spark, sf_dir):
    """Ids of the tasks of chosen materials, of the jobs of these tasks, and so on: a chain of semi joins."""
    m, t, j = (collection(spark, sf_dir, n) for n in ("materials", "tasks", "jobs"))
    chosen = m.where("subject = 'BUILDING'").select(F.col("id").alias("material_id"))
    own = t.join(chosen, "material_id", "left_semi")
    linked = j.join(own.select(F.col("id").alias("parse_task_id")), "parse_task_id", "left_semi")
    return own.select(F.lit("task").alias("kind"), "id").unionByName(linked.select(F.lit("job").alias("kind"), "id"))


def unpacked_check(spark, sf_dir):
    """Which owners' expanded objects all occur among the entries of their archive."""
    o = collection(spark, sf_dir, "objects")
    inner = o.where("nr <= 3").select("owner", "name").distinct()
    missing = o.where("nr > 2").join(inner, ["owner", "name"], "left_anti").groupBy("owner").agg(F.count("*").alias("missing"))
    return o.select("owner").distinct().join(missing, "owner", "left").select("owner", F.coalesce("missing", F.lit(0)).alias("missing"), F.col("missing").isNull().alias("safe"))


QUERIES = {
    "j1_orphan_tasks": (_rule(audit.orphan_tasks, "tasks", "materials"), with_collections("tasks materials", RULES["orphan_tasks"])),
    "j2_orphan_jobs": (_rule(audit.orphan_jobs, "jobs", "tasks"), with_collections("jobs tasks", RULES["orphan_jobs"])),
    "j3_dangling_jobs": (_rule(audit.dangling_jobs, "materials", "jobs"), with_collections("materials jobs", RULES["dangling_jobs"])),
    "j4_idle_ai_tasks": (_rule(audit.idle_ai_tasks, "tasks", "jobs"), with_collections("tasks jobs", RULES["idle_ai_tasks"])),
    "j6_missing_files": (_rule(audit.missing_files, "materials", "tasks", "objects"), with_collections("materials tasks objects", RULES["missing_files"])),
    "j5_a8_orphan_objects": (orphan_buckets, with_collections("objects materials", "SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM objects WHERE trim(coalesce(list_extract(string_split(name, '/'), 2), '')) NOT IN (SELECT id FROM materials) GROUP BY ROLLUP (bucket)")),
    "u5_audit": (whole, with_collections("materials tasks jobs objects", _EVERY)),
    "a6_finding_kinds": (kinds, with_collections("materials tasks jobs objects", f"SELECT kind, count(*) AS n FROM ({_EVERY}) GROUP BY kind")),
    "j10_related_ids": (
        related_ids,
        with_collections("materials tasks jobs", "WITH own AS (SELECT id FROM tasks WHERE material_id IN (SELECT id FROM materials WHERE subject = 'BUILDING')) SELECT 'task' AS kind, id FROM own UNION ALL SELECT 'job', id FROM jobs WHERE parse_task_id IN (SELECT id FROM own)"),
    ),
    "j11_unpacked_check": (
        unpacked_check,
        with_collections("objects", "WITH x AS (SELECT owner, count(*) AS n FROM objects o WHERE nr > 2 AND NOT EXISTS (SELECT 1 FROM objects i WHERE i.owner = o.owner AND i.name = o.name AND i.nr <= 3) GROUP BY owner) SELECT DISTINCT o.owner, coalesce(x.n, 0) AS missing, x.n IS NULL AS safe FROM objects o LEFT JOIN x ON x.owner = o.owner"),
    ),
}
