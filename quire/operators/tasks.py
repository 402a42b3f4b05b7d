"""Task state transitions, failure routing and queue order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text_or, truthy

CANCELED_MESSAGE = "用户已取消 / 测试终止"
#: The literals of older records and what they are called now.
MIGRATIONS = {"success": "completed", "succeeded": "confirmed"}
#: What external services report.
EXTERNAL = {
    "done": ("done", "success", "completed", "succeeded", "finished", "complete"),
    "failed": ("failed", "error", "failure", "canceled", "cancelled"),
    "queued": ("queued", "pending"),
    "processing": ("processing", "running"),
}
#: What marks a failure of the vision model and of the graphics backend.
VLM_SIGNS = ("split_with_sizes", "Image features and image tokens do not match", "out of range integral type conversion attempted")
MPS_SIGNS = ("MPS backend out of memory", "kIOGPUCommandBufferCallbackErrorInnocentVictim")
MOST_RETRIES = 5


def normalize_canceled(tasks: DataFrame) -> DataFrame:
    """Tasks with a cancel time or state get the fixed canceled state, stage and message."""
    hit = F.col("canceled_at").isNotNull() | F.coalesce(F.col("state") == "canceled", F.lit(False))
    fixed = {"state": "canceled", "stage": "canceled", "message": CANCELED_MESSAGE}
    return tasks.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in fixed.items()})


def canonical_states(rows: DataFrame) -> DataFrame:
    """Older state literals replaced, with a note in the message."""
    state, message = F.col("state"), F.col("message")
    for old, new in MIGRATIONS.items():
        message = F.when(F.col("state") == old, F.concat(text_or(F.col("message"), ""), F.lit(f" [startup-migration: {old}→{new}]"))).otherwise(message)
        state = F.when(F.col("state") == old, new).otherwise(state)
    return rows.withColumns({"state": state, "message": message})


def _any(text: Column, signs: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for s in signs:
        found = found | text.contains(s)
    return found


def failure_category(text: Column) -> Column:
    return F.when(_any(text, VLM_SIGNS), "hybrid-vlm-runtime-failure").when(_any(text, MPS_SIGNS), "hybrid-mps-runtime-failure")


def submit_failure(retries: Column, unreachable: Column, external_id: Column) -> dict[str, Column]:
    """Where a failed task goes: back to pending while an unreachable service leaves retries, else to its failure stage."""
    again = unreachable & (F.coalesce(retries, F.lit(0)) + 1 <= MOST_RETRIES)
    return {
        "next_state": F.when(again, "pending").otherwise("failed"),
        "next_stage": F.when(again, "upload").when(unreachable, "submit-failed-retryable").when(truthy(external_id), "mineru-failed").otherwise("execution-failed"),
    }


def external_status(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in EXTERNAL.items():
        out = F.when(F.lower(raw).isin(*words), name).otherwise(out)
    return out


def external_stage(normalized: Column) -> Column:
    return F.when(normalized == "queued", "mineru-queued").when(normalized == "processing", "mineru-processing")


def queue_or_processing(status: Column, started_at: Column, ahead: Column) -> Column:
    """queued, processing, or null once the service is done."""
    low = F.lower(status)
    queued = low.isin("pending", "queued") | (started_at.isNull() & (low != "processing")) | (F.coalesce(ahead, F.lit(0)) > 0)
    return F.when(low.isin(*EXTERNAL["done"]), F.lit(None).cast("string")).when(queued, "queued").otherwise("processing")


def job_outcome(state: Column) -> dict[str, Column]:
    """What a job's state makes of its task and material when it ends."""
    return {
        "task_state": F.when(state == "confirmed", "completed").when(state == "review-pending", "review-pending").otherwise("failed"),
        "material_status": F.when(state == "confirmed", "completed").when(state == "review-pending", "reviewing").when(state == "failed", "failed").otherwise("processing"),
        "ai_status": F.when(state == "failed", "failed").otherwise("analyzed"),
    }


def fifo(tasks: DataFrame, slots: int) -> DataFrame:
    """The next tasks: those with an external id first, then the oldest, then by id; canceled ones are left out."""
    waiting = tasks.where(F.col("canceled_at").isNull() & F.coalesce(F.col("state") != "canceled", F.lit(True)))
    return waiting.orderBy(truthy(F.col("mineru_task_id")).desc(), F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp")), "id").limit(slots)


#: What the operational sets name.
LOCAL_ENGINE = "local-mineru"
WORKING_STAGES = ("mineru-processing", "mineru-queued", "result-fetching")
RETRY_MARK = "可重试"
LIVE_STATES = ("pending", "running", "ai-pending", "ai-running")
HYBRID = "hybrid-auto-engine"


def _meta(key: str) -> Column:
    return F.get_json_object("metadata", f"$.{key}")


def _nothing(c: Column) -> Column:
    """Null, empty or zero."""
    return c.isNull() | c.isin("", "0", "false")


def operational_sets(tasks: DataFrame) -> DataFrame:
    """Each task with the operational sets that it is in, from engine, state, stage, message and the metadata."""
    state, stage = F.col("state"), F.col("stage")
    own = (F.col("engine") == LOCAL_ENGINE) & _nothing(_meta("canceledAt"))
    external, done = ~_nothing(_meta("mineruTaskId")), _meta("mineruStatus") == "completed"
    sets = {
        "running_external": (state == "running") & external & stage.isin(*WORKING_STAGES),
        "drifting": external & ((state == "pending") | ((state == "running") & stage.isin("upload", "process"))),
        "not_ingested": (state != "canceled") & external & done & _nothing(_meta("parsedFilesCount")),
        "retryable": (state != "canceled") & ((stage == "submit-failed-retryable") | F.coalesce(F.col("message").contains(RETRY_MARK), F.lit(False))),
        "takeover": (state != "canceled") & done & (((state == "failed") & external) | ((state == "running") & (stage == "mineru-processing"))),
    }
    flagged = tasks.withColumns({k: F.coalesce(own & v, F.lit(False)) for k, v in sets.items()})
    return flagged.withColumns({"queued": F.col("running_external") & (stage == "mineru-queued"), "current": F.col("running_external") & (stage == "mineru-processing")})


def waiting_tasks(tasks: DataFrame) -> DataFrame:
    """The queued ones of the operational sets, the oldest first."""
    return operational_sets(tasks).where("queued").orderBy(F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp")), "id")


def current_task(tasks: DataFrame, place: str = "seq") -> DataFrame:
    """The one task that the operational sets call current: of those processed outside, the first by ``place``, the order of the collection; no row if there is none."""
    names = [c for c in tasks.columns]
    return operational_sets(tasks).where("current").agg(F.min_by(F.struct(*names), place).alias("row")).where("row is not null").select("row.*")


def active_task(tasks: DataFrame) -> DataFrame:
    """One row: the only running task, or without any the only drifting one, else null."""
    only = lambda flag: F.max(F.when(F.col(flag), F.col("id")))
    sets = operational_sets(tasks).agg(F.count_if("running_external").alias("running"), F.count_if("drifting").alias("drift"), only("running_external").alias("a"), only("drifting").alias("b"))
    return sets.select("running", "drift", F.when(F.col("running") == 1, F.col("a")).when((F.col("running") == 0) & (F.col("drift") == 1), F.col("b")).alias("active"))


def diagnostic_sets(tasks: DataFrame) -> DataFrame:
    """The sets as the service diagnosis defines them; unlike ``operational_sets`` they ignore engine and cancellation."""
    state, stage = F.col("state"), F.col("stage")
    external, status = ~_nothing(_meta("mineruTaskId")), _meta("mineruStatus")
    sets = {
        "active": state.isin("pending", "running", "result-store", "ai-pending", "ai-running"),
        "queued": stage == "mineru-queued",
        "processing": stage == "mineru-processing",
        "not_ingested": (state == "failed") & external & (status == "completed") & _nothing(_meta("parsedFilesCount")),
        "retryable": state.isin("failed", "pending") & ~external & ((stage == "submit-failed-retryable") | F.coalesce(F.col("message").contains(RETRY_MARK), F.lit(False))),
        "takeover": (state == "failed") & external & F.coalesce(~status.isin("failed", "completed", "not_found", "artifact-empty"), F.lit(True)),
    }
    return tasks.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in sets.items()})


def diagnosis(reachable: Column, processing: Column, own_processing: Column, found: Column, found_state: Column) -> dict[str, Column]:
    """Status and kind of the external service, from whether it answers, how many tasks it works on, whether a task of ours is one of them, and otherwise which of ours it was found to work on, and in what state."""
    idle = F.coalesce(processing, F.lit(0)) == 0
    ended = found.isNotNull() & F.coalesce(found_state.isin("failed", "canceled"), F.lit(False))
    known = own_processing | found.isNotNull()
    kind = F.when(~reachable, "unknown").when(idle, "idle").when(own_processing, "known-task-processing").when(ended, "known-failed-but-mineru-processing").when(known, "known-task-processing").otherwise("orphan-processing-blocker")
    return {"status": F.when(~reachable, "unreachable").when(idle, "healthy").when(own_processing | (known & ~ended), "busy").otherwise("blocked"), "kind": kind}


def failure(text: Column) -> dict[str, Column]:
    """Category of a failure, the engine it is laid to, and whether another backend may be tried."""
    category = failure_category(text)
    return {"category": category, "engine": F.when(category.isNotNull(), HYBRID), "fallback": category.isNotNull()}


def adjudicated(raw: Column, startup: bool = False) -> dict[str, Column]:
    """What an external status makes of a stale task and of its material (status, parse and AI status); null where nothing changes.

    At start-up a finished task goes straight to storing its result, and an
    unknown status fails like a lost one.
    """
    status = external_status(raw)
    working = F.coalesce(status.isin("queued", "processing"), F.lit(False))
    lost = F.lower(raw) == "not_found"
    if startup:
        lost = lost | (raw.isNotNull() & (raw != "") & status.isNull())
    done = status == "done"
    return {
        "task_state": F.when(working, "running").when(done, "result-store" if startup else "running").when((status == "failed") | lost, "failed"),
        "task_stage": F.when(working, external_stage(status)).when(done, "store" if startup else "result-fetching").when(status == "failed", "mineru-failed"),
        "external": F.when(done, "completed").when(status == "failed", "failed").when(lost, F.lower(raw)).otherwise(status if startup else F.when(working, F.lower(raw))),
        "material_status": F.when(status == "failed", "failed").when((working | done) & F.lit(not startup), "processing"),
        "material_parse": F.when(status == "failed", "failed").when(done & F.lit(not startup), "completed").when(working & F.lit(not startup), status),
        "material_ai": F.when(status == "failed", "pending"),
    }


def live_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that a reset would cancel."""
    return tasks.where(F.col("state").isin(*LIVE_STATES))


def live_counts(tasks: DataFrame) -> DataFrame:
    """How many live tasks there are, in all and by state."""
    return live_tasks(tasks).agg(F.count("*").alias("live"), *(F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in LIVE_STATES))


def overdue(updated: Column, now: Column, timeout_seconds: Column | int, grace_seconds: int = 60) -> Column:
    """Whether the last update is longer ago than the timeout and the grace."""
    limit = timeout_seconds if isinstance(timeout_seconds, Column) else F.lit(timeout_seconds)
    return F.unix_timestamp(now) - F.unix_timestamp(updated) > limit + grace_seconds


def jobs_of_tasks(jobs: DataFrame) -> DataFrame:
    """Per task that has jobs: their ids in order, and whether any of them is waiting or running; a task has few jobs."""
    return jobs.where(truthy(F.col("parse_task_id"))).groupBy("parse_task_id").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.bool_or(F.col("state").isin("pending", "running")).alias("active"))


def percent(done: Column, total: Column) -> Column:
    """Progress in whole percent; 0 without a positive total."""
    return F.coalesce(F.round(F.try_divide(done, F.when(total > 0, total)) * 100).cast("bigint"), F.lit(0))


def confirmed_at_startup(materials: DataFrame, tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, task_id, job_id) of materials to bring up to date: of completed tasks whose last job, by ``seq``, is confirmed."""
    last = jobs.where(truthy(F.col("parse_task_id"))).groupBy(F.col("parse_task_id").alias("task_id")).agg(F.max_by(F.struct("id", "state"), "seq").alias("job")).where("job.state = 'confirmed'")
    done = tasks.where("state = 'completed'").select(F.col("id").alias("task_id"), F.col("material_id").alias("id"))
    return last.join(done, "task_id").join(materials.select("id"), "id").select("id", "task_id", F.col("job.id").alias("job_id"))
