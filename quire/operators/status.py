"""Status derivation: display buckets, current tasks, drift and consistency labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import blank, text_or, truthy

#: The states each rule names.
CANONICAL_TASK_STATES = ("uploading", "pending", "running", "result-store", "ai-pending", "ai-running", "review-pending", "completed", "failed", "canceled")
CANONICAL_JOB_STATES = ("pending", "running", "confirmed", "review-pending", "failed")
VIEW_ACTIVE_STATES = ("pending", "running", "result-store", "ai-pending", "ai-running", "review-pending")
FLOWING_STATES = ("uploading", "pending", "running", "result-store", "ai-pending", "ai-running")
FAILED_STATES = ("failed", "artifact-empty", "mineru-failed", "canceled")
STATE_LABELS = {
    "uploading": "上传中", "pending": "等待中", "running": "解析中", "result-store": "产物落库", "ai-pending": "等待 AI", "ai-running": "AI 分析中",
    "review-pending": "解析完成，待人工复核", "completed": "已完成", "failed": "失败", "canceled": "已取消",
}
NO_TASK = "暂无关联任务 / 需审计"


def bucket(state: Column, stage: Column) -> Column:
    return (
        F.when((state == "running") & (stage == "mineru-queued"), "queued")
        .when(state.isin("uploading", "pending", "ai-pending"), "queued")
        .when(state.isin("running", "result-store", "ai-running"), "processing")
        .when(state == "review-pending", "reviewing")
        .when(state.isin("completed", "failed", "canceled"), state)
        .otherwise("unknown")
    )


def current_tasks(tasks: DataFrame) -> DataFrame:
    """One task per material: an active one if there is any, else the last updated; ties by the older sequence."""
    active = F.coalesce(F.col("state").isin(*VIEW_ACTIVE_STATES), F.lit(False))
    when = F.coalesce("updated_at", "created_at", F.lit("1970-01-01").cast("timestamp"))
    best = Window.partitionBy("material_id").orderBy(active.desc(), F.when(~active, when).desc(), "seq")
    return tasks.where(~blank(F.col("material_id"))).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def latest_tasks(tasks: DataFrame) -> DataFrame:
    newest = Window.partitionBy("material_id").orderBy(F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp")).desc(), "seq")
    return tasks.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def material_view(materials: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each material with its current task's bucket, display text, failure message, link and drift."""
    own = current_tasks(tasks).select(
        F.col("material_id").alias("id"), F.col("id").alias("task_id"), "state", "stage", "message", "error_message", "mineru_task_id", F.col("mineru_status").alias("task_mineru"),
        F.col("parsed_files_count").alias("task_count"),
    )
    joined = materials.join(own, "id", "left")
    has = F.col("task_id").isNotNull()
    label = F.coalesce(F.create_map(*[F.lit(x) for pair in STATE_LABELS.items() for x in pair])[F.col("state")], F.lit("未知"))
    taken_over = truthy(F.col("mineru_task_id")) & (F.col("task_mineru") == "completed") & (F.coalesce("task_count", F.lit(0)) == 0)
    retry = (F.col("stage") == "submit-failed-retryable") | F.col("message").contains("可重试")
    display = (
        F.when(~has, NO_TASK)
        .when((F.col("state") == "failed") & taken_over, "MinerU 已完成，结果待接管")
        .when((F.col("state") == "failed") & retry, "提交 MinerU 失败，可重试")
        .when(F.col("stage") == "mineru-queued", "MinerU 排队中")
        .when(F.col("stage") == "mineru-processing", "MinerU 正在解析")
        .otherwise(label)
    )
    drift = (
        F.when(~has & ((F.col("status") == "processing") | (F.col("mineru_status") == "processing")), NO_TASK)
        .when((F.col("state") == "completed") & (F.col("mineru_status") == "processing"), "Material 元数据残留 processing")
        .when((F.col("state") == "completed") & blank(F.col("markdown_object_name")), "任务显示完成但缺少解析产物")
        .when(F.col("state").isin("failed", "canceled") & (F.col("status") == "processing"), "任务已终止但素材状态未同步")
    )
    return joined.select(
        "id", "title", "task_id", bucket(F.col("state"), F.col("stage")).alias("bucket"), display.alias("display_status"),
        F.when(has, text_or(F.col("error_message"), F.col("message"))).alias("failure_message"), F.when(has, F.concat(F.lit("/tasks/"), "task_id")).alias("task_url"), drift.alias("drift_reason"),
    )


def consistency(task_state: Column, status: Column, mineru: Column, ai: Column) -> Column:
    return (
        F.when((task_state == "review-pending") & (status == "reviewing") & (mineru == "completed") & ai.isin("analyzed", "failed"), "待复核")
        .when((task_state == "completed") & (status == "completed") & (mineru == "completed") & (ai == "analyzed"), "已一致")
        .when(task_state.isin(*FLOWING_STATES), "流转中")
        .when(task_state.isin("failed", "canceled"), "已终止")
        .otherwise("需审计")
    )


def enrich(materials: DataFrame, tasks: DataFrame) -> DataFrame:
    """Materials with the parse and AI status of their latest task and whether the catalog admits them."""
    last = latest_tasks(tasks).select(F.col("material_id").alias("id"), F.col("id").alias("latest_task"), "state", F.col("parsed_files_count").cast("string").alias("task_count"))
    m = materials.join(last, "id", "left")
    state, has = F.col("state"), F.col("latest_task").isNotNull()
    either = lambda value: (F.coalesce(F.col("mineru_status") == value, F.lit(False))) | (F.coalesce(F.col("status") == value, F.lit(False)))
    from_task = F.when(state.isin("completed", "done", "ai-pending", "ai-running", "review-pending"), "completed").when(state.isin(*FAILED_STATES), "failed").when(state == "pending", "pending").otherwise("processing")
    alone = F.when(either("completed"), "completed").when(either("failed"), "failed").otherwise(text_or(F.col("mineru_status"), "未知"))
    ai = F.when(state == "ai-running", "analyzing").when(state == "ai-pending", "pending").when(state == "review-pending", "analyzed").otherwise(text_or(F.col("ai_status"), "pending"))
    m = m.withColumn("derived_mineru", F.when(has, from_task).otherwise(alone)).withColumn("derived_ai", ai)
    count = F.coalesce(F.coalesce("parsed_files_count", "task_count").try_cast("bigint"), F.lit(0))
    bad = lambda c: F.coalesce(F.col(c).isin(*FAILED_STATES), F.lit(False))
    usable = (F.col("derived_mineru") == "completed") & ~bad("mineru_status") & ~bad("status") & (count > 0)
    return m.withColumn("parsed_count", count).withColumn("is_usable", usable)
