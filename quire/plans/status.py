"""Status derivation over the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import status, tasks
from quire.plans.proxies import collection, with_collections


def buckets(spark, sf_dir):
    t = collection(spark, sf_dir, "tasks")
    return t.select("id", status.bucket(F.col("state"), F.col("stage")).alias("bucket"))


def bucket_counts(spark, sf_dir):
    t = collection(spark, sf_dir, "tasks").withColumn("bucket", status.bucket(F.col("state"), F.col("stage")))
    names = ("queued", "processing", "reviewing", "completed", "failed", "canceled", "unknown")
    return t.agg(F.count("*").alias("total"), *(F.count_if(F.col("bucket") == n).alias(f"n_{n}") for n in names))


def current(spark, sf_dir):
    return status.current_tasks(collection(spark, sf_dir, "tasks")).select("material_id", "id", "state")


def latest(spark, sf_dir):
    return status.latest_tasks(collection(spark, sf_dir, "tasks")).select("material_id", "id", "state")


def view(spark, sf_dir):
    return status.material_view(collection(spark, sf_dir, "materials"), collection(spark, sf_dir, "tasks"))


def labels(spark, sf_dir):
    t, m = collection(spark, sf_dir, "tasks"), collection(spark, sf_dir, "materials")
    both = t.join(m.select(F.col("id").alias("material_id"), "status", F.col("mineru_status").alias("m_mineru"), "ai_status"), "material_id")
    return both.select("id", status.consistency(F.col("state"), F.col("status"), F.col("m_mineru"), F.col("ai_status")).alias("label"))


def enriched(spark, sf_dir):
    rows = status.enrich(collection(spark, sf_dir, "materials"), collection(spark, sf_dir, "tasks"))
    return rows.select("id", "derived_mineru", "derived_ai", "parsed_count", "is_usable")


def canceled(spark, sf_dir):
    return tasks.normalize_canceled(collection(spark, sf_dir, "tasks")).select("id", "state", "stage", "message")


def canonical(spark, sf_dir):
    return tasks.canonical_states(collection(spark, sf_dir, "tasks")).select("id", "state", "message")


def failures(spark, sf_dir):
    lines = collection(spark, sf_dir, "log_lines")
    sign = F.when(F.col("seq") % 4 == 0, "torch split_with_sizes").when(F.col("seq") % 4 == 1, "MPS backend out of memory").otherwise("")
    return lines.select("seq", tasks.failure_category(F.concat_ws(" ", "line", sign)).alias("category"))


def submit_routes(spark, sf_dir):
    t = collection(spark, sf_dir, "tasks").where("state = 'failed'")
    return t.select("id", *(c.alias(n) for n, c in tasks.submit_failure(F.col("retries"), F.col("stage") == "submit-failed-retryable", F.col("mineru_task_id")).items()))


def external(spark, sf_dir):
    o = collection(spark, sf_dir, "jobs")
    raw = F.element_at(F.array(*map(F.lit, ("Done", "error", "queued", "RUNNING", "cancelled", "lost"))), (F.col("seq") % 6 + 1).cast("int"))
    return o.select("id", tasks.external_status(raw).alias("normalized"), tasks.external_stage(tasks.external_status(raw)).alias("stage"))


def waiting(spark, sf_dir):
    t = collection(spark, sf_dir, "tasks")
    return t.select("id", tasks.queue_or_processing(F.col("mineru_status"), F.col("canceled_at"), F.greatest(F.lit(0), F.col("retries") - 2)).alias("phase"))


def outcomes(spark, sf_dir):
    return collection(spark, sf_dir, "jobs").select("id", *(c.alias(n) for n, c in tasks.job_outcome(F.col("state")).items()))


def fifo(spark, sf_dir):
    return tasks.fifo(collection(spark, sf_dir, "tasks"), 7).select("id", "created_at")


_BUCKET = """CASE WHEN state = 'running' AND stage = 'mineru-queued' THEN 'queued' WHEN state IN ('uploading', 'pending', 'ai-pending') THEN 'queued'
  WHEN state IN ('running', 'result-store', 'ai-running') THEN 'processing' WHEN state = 'review-pending' THEN 'reviewing' WHEN state IN ('completed', 'failed', 'canceled') THEN state ELSE 'unknown' END"""
_ACTIVE = "coalesce(state IN ('pending', 'running', 'result-store', 'ai-pending', 'ai-running', 'review-pending'), false)"
_CURRENT = f"""cur AS (SELECT * FROM tasks WHERE material_id <> '' QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY {_ACTIVE} DESC,
  CASE WHEN NOT {_ACTIVE} THEN coalesce(updated_at, created_at, TIMESTAMP '1970-01-01') END DESC NULLS LAST, seq) = 1)"""
_LATEST = "lat AS (SELECT * FROM tasks QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY created_at DESC, seq) = 1)"

QUERIES = {
    "b1_task_bucket": (buckets, with_collections("tasks", f"SELECT id, {_BUCKET} AS bucket FROM tasks")),
    "a4_bucket_counts": (
        bucket_counts,
        with_collections("tasks", f"WITH b AS (SELECT {_BUCKET} AS bucket FROM tasks) SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (bucket = '{n}') AS n_{n}" for n in ("queued", "processing", "reviewing", "completed", "failed", "canceled", "unknown")) + " FROM b"),
    ),
    "j8_current_task": (current, with_collections("tasks", f"WITH {_CURRENT} SELECT material_id, id, state FROM cur")),
    "w3_latest_task": (latest, with_collections("tasks", f"WITH {_LATEST} SELECT material_id, id, state FROM lat")),
    "b2_b3_material_view": (
        view,
        with_collections(
            "materials tasks",
            f"""WITH {_CURRENT}, v AS (SELECT m.*, c.id AS task_id, c.state, c.stage, c.message, c.error_message, c.mineru_task_id, c.mineru_status AS tm, coalesce(c.parsed_files_count, 0) AS n
                FROM materials m LEFT JOIN cur c ON c.material_id = m.id)
            SELECT id, title, task_id, {_BUCKET} AS bucket,
              CASE WHEN task_id IS NULL THEN '暂无关联任务 / 需审计'
                WHEN state = 'failed' AND mineru_task_id <> '' AND tm = 'completed' AND n = 0 THEN 'MinerU 已完成，结果待接管'
                WHEN state = 'failed' AND (stage = 'submit-failed-retryable' OR contains(message, '可重试')) THEN '提交 MinerU 失败，可重试'
                WHEN stage = 'mineru-queued' THEN 'MinerU 排队中' WHEN stage = 'mineru-processing' THEN 'MinerU 正在解析'
                ELSE CASE state WHEN 'uploading' THEN '上传中' WHEN 'pending' THEN '等待中' WHEN 'running' THEN '解析中' WHEN 'result-store' THEN '产物落库' WHEN 'ai-pending' THEN '等待 AI'
                  WHEN 'ai-running' THEN 'AI 分析中' WHEN 'review-pending' THEN '解析完成，待人工复核' WHEN 'completed' THEN '已完成' WHEN 'failed' THEN '失败' WHEN 'canceled' THEN '已取消' ELSE '未知' END END AS display_status,
              CASE WHEN task_id IS NULL THEN NULL WHEN error_message <> '' THEN error_message ELSE message END AS failure_message, '/tasks/' || task_id AS task_url,
              CASE WHEN task_id IS NULL THEN CASE WHEN status = 'processing' OR mineru_status = 'processing' THEN '暂无关联任务 / 需审计' END
                WHEN state = 'completed' AND mineru_status = 'processing' THEN 'Material 元数据残留 processing'
                WHEN state = 'completed' AND coalesce(markdown_object_name, '') = '' THEN '任务显示完成但缺少解析产物'
                WHEN state IN ('failed', 'canceled') AND status = 'processing' THEN '任务已终止但素材状态未同步' END AS drift_reason FROM v""",
        ),
    ),
    "b4_consistency_label": (
        labels,
        with_collections(
            "materials tasks",
            """SELECT t.id, CASE WHEN t.state = 'review-pending' AND m.status = 'reviewing' AND m.mineru_status = 'completed' AND m.ai_status IN ('analyzed', 'failed') THEN '待复核'
              WHEN t.state = 'completed' AND m.status = 'completed' AND m.mineru_status = 'completed' AND m.ai_status = 'analyzed' THEN '已一致'
              WHEN t.state IN ('uploading', 'pending', 'running', 'result-store', 'ai-pending', 'ai-running') THEN '流转中' WHEN t.state IN ('failed', 'canceled') THEN '已终止' ELSE '需审计' END AS label
              FROM tasks t JOIN materials m ON m.id = t.material_id""",
        ),
    ),
    "j7_b5_f5_enriched_materials": (
        enriched,
        with_collections(
            "materials tasks",
            f"""WITH {_LATEST}, j AS (SELECT m.*, t.id AS task, t.state, CAST(t.parsed_files_count AS VARCHAR) AS tc FROM materials m LEFT JOIN lat t ON t.material_id = m.id),
            d AS (SELECT *, CASE WHEN task IS NOT NULL THEN CASE WHEN state IN ('completed', 'done', 'ai-pending', 'ai-running', 'review-pending') THEN 'completed'
                WHEN state IN ('failed', 'artifact-empty', 'mineru-failed', 'canceled') THEN 'failed' WHEN state = 'pending' THEN 'pending' ELSE 'processing' END
              WHEN mineru_status = 'completed' OR status = 'completed' THEN 'completed' WHEN mineru_status = 'failed' OR status = 'failed' THEN 'failed' ELSE coalesce(nullif(mineru_status, ''), '未知') END AS derived_mineru,
              CASE state WHEN 'ai-running' THEN 'analyzing' WHEN 'ai-pending' THEN 'pending' WHEN 'review-pending' THEN 'analyzed' ELSE coalesce(nullif(ai_status, ''), 'pending') END AS derived_ai,
              coalesce(TRY_CAST(coalesce(parsed_files_count, tc) AS BIGINT), 0) AS parsed_count FROM j)
            SELECT id, derived_mineru, derived_ai, parsed_count, derived_mineru = 'completed' AND coalesce(mineru_status, '') NOT IN ('failed', 'artifact-empty', 'mineru-failed', 'canceled')
              AND coalesce(status, '') NOT IN ('failed', 'artifact-empty', 'mineru-failed', 'canceled') AND parsed_count > 0 AS is_usable FROM d""",
        ),
    ),
    "b6_canceled_normalized": (canceled, with_collections("tasks", "SELECT id, CASE WHEN c THEN 'canceled' ELSE state END AS state, CASE WHEN c THEN 'canceled' ELSE stage END AS stage, CASE WHEN c THEN '用户已取消 / 测试终止' ELSE message END AS message FROM (SELECT *, canceled_at IS NOT NULL OR coalesce(state = 'canceled', false) AS c FROM tasks)")),
    "b7_canonical_states": (canonical, with_collections("tasks", "SELECT id, CASE state WHEN 'success' THEN 'completed' WHEN 'succeeded' THEN 'confirmed' ELSE state END AS state, CASE state WHEN 'success' THEN coalesce(message, '') || ' [startup-migration: success→completed]' WHEN 'succeeded' THEN coalesce(message, '') || ' [startup-migration: succeeded→confirmed]' ELSE message END AS message FROM tasks")),
    "b10_failure_category": (
        failures,
        with_collections("log_lines", "SELECT seq, CASE seq % 4 WHEN 0 THEN 'hybrid-vlm-runtime-failure' WHEN 1 THEN 'hybrid-mps-runtime-failure' END AS category FROM log_lines"),
    ),
    "b11_submit_failure": (
        submit_routes,
        with_collections(
            "tasks",
            """SELECT id, CASE WHEN stage = 'submit-failed-retryable' AND retries + 1 <= 5 THEN 'pending' ELSE 'failed' END AS next_state,
              CASE WHEN stage = 'submit-failed-retryable' THEN CASE WHEN retries + 1 <= 5 THEN 'upload' ELSE 'submit-failed-retryable' END WHEN mineru_task_id <> '' THEN 'mineru-failed' ELSE 'execution-failed' END AS next_stage FROM tasks WHERE state = 'failed'""",
        ),
    ),
    "b12_external_status": (
        external,
        with_collections(
            "jobs",
            """WITH r AS (SELECT id, list_extract(['Done', 'error', 'queued', 'RUNNING', 'cancelled', 'lost'], CAST(seq % 6 + 1 AS INT)) AS raw FROM jobs),
            n AS (SELECT id, CASE WHEN lower(raw) IN ('done', 'success', 'completed', 'succeeded', 'finished', 'complete') THEN 'done' WHEN lower(raw) IN ('failed', 'error', 'failure', 'canceled', 'cancelled') THEN 'failed'
              WHEN lower(raw) IN ('queued', 'pending') THEN 'queued' WHEN lower(raw) IN ('processing', 'running') THEN 'processing' END AS normalized FROM r)
            SELECT id, normalized, CASE normalized WHEN 'queued' THEN 'mineru-queued' WHEN 'processing' THEN 'mineru-processing' END AS stage FROM n""",
        ),
    ),
    "b13_queued_or_processing": (
        waiting,
        with_collections(
            "tasks",
            """SELECT id, CASE WHEN mineru_status = 'completed' THEN NULL WHEN mineru_status IN ('pending', 'queued') OR (canceled_at IS NULL AND mineru_status <> 'processing') OR coalesce(retries, 0) > 2 THEN 'queued'
              ELSE 'processing' END AS phase FROM tasks""",
        ),
    ),
    "b8_job_outcome": (
        outcomes,
        with_collections(
            "jobs",
            """SELECT id, CASE state WHEN 'confirmed' THEN 'completed' WHEN 'review-pending' THEN 'review-pending' ELSE 'failed' END AS task_state,
              CASE state WHEN 'confirmed' THEN 'completed' WHEN 'review-pending' THEN 'reviewing' WHEN 'failed' THEN 'failed' ELSE 'processing' END AS material_status,
              CASE WHEN state = 'failed' THEN 'failed' ELSE 'analyzed' END AS ai_status FROM jobs""",
        ),
    ),
    "o7_f10_fifo": (
        fifo,
        with_collections("tasks", "SELECT id, created_at FROM tasks WHERE canceled_at IS NULL AND coalesce(state <> 'canceled', true) ORDER BY coalesce(mineru_task_id <> '', false) DESC, coalesce(created_at, TIMESTAMP '1970-01-01'), id LIMIT 7"),
    ),
}
