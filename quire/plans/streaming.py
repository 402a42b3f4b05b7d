"""Streams over ``events`` run to the end of what is there, checked against the batch results (R family, S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import sources
from quire.plans.logs import ROWS, SUM
from quire.plans.proxies import collection, with_collections
from quire.sources import table
from quire.streaming import Replay, events, keep_state, logs, new_folder, poll, polled, read_events, run_now, stateful


def _tenth():
    """Which ten days of the month."""
    return F.expr("CAST(floor((least(day(ts), 30) - 1) / 10) AS INT)")


def _stream(spark, sf_dir):
    return read_events(spark, f"{sf_dir}/events.parquet")


def of_task(spark, sf_dir):
    return run_now(events.of_task(_stream(spark, sf_dir), "user_id", 3).select("event_id", "event_type"))


def changes(spark, sf_dir):
    meaning = F.concat_ws("|", "event_type", (F.col("value") > 50).cast("string"))
    return run_now(stateful.changes_only(_stream(spark, sf_dir), "user_id", "ts", "event_id", meaning)).select(F.col("key").alias("event_id"), F.col("task").alias("user_id"))


def changes_over_batches(spark, sf_dir):
    meaning = F.concat_ws("|", "event_type", (F.col("value") > 50).cast("string"))
    replay, folder = Replay(table(spark, sf_dir, "events"), _tenth(), 3), new_folder(spark)
    for _ in replay.steps():
        found = run_now(stateful.changes_only(replay.stream(), "user_id", "ts", "event_id", meaning), folder=folder)
    return found.select(F.col("key").alias("event_id"), F.col("task").alias("user_id"))


def newest_of_streams(spark, sf_dir):
    """The ring buffer: 500 newest events of each type, kept over several batches and read from the state."""
    replay, folder = Replay(table(spark, sf_dir, "events"), F.col("event_id") % 3, 3), new_folder(spark)
    for _ in replay.steps():
        keep_state(stateful.newest(replay.stream(), "event_type", "ts", "event_id", ["ts", "event_id", "user_id"]), folder)
    return stateful.recent(spark, folder).select("stream", F.col("key").alias("event_id"), "user_id")


def attributed_late(spark, sf_dir):
    """Starts are an hour after the first event of each user; half of the observations and of the starts come later than the others."""
    e = table(spark, sf_dir, "events")
    starts = e.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 1 HOUR")).alias("begun"))
    seen, begun, folder = Replay(e.select("event_id", "user_id", "ts"), F.col("event_id") % 2, 2), Replay(starts, F.col("user_id") % 2, 2), new_folder(spark)
    for _ in zip(seen.steps(), begun.steps(), strict=True):
        found = run_now(events.attributed_late(seen.stream(), begun.stream(), "user_id", "ts", "begun", "3650 days", "'3650' DAY").select("event_id", "user_id"), folder=folder)
    return found


def judged_by_batch(spark, sf_dir):
    """Which tasks are eligible changes between batches: those of batch k have a number that leaves k modulo 3."""
    folder = new_folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("source"), "ts", F.when(F.col("event_id") % 5 == 0, "api-alive-only").otherwise("active-progress").alias("level"))
    tasks = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 25).alias("source"), F.col("c_custkey").alias("task"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2999-01-01")).otherwise("1970-01-01").cast("timestamp_ntz").alias("started_at")).where("task <= 60")
    replay = Replay(e, F.col("event_id") % 3, 3)
    for _ in replay.steps():
        poll(replay.stream(), events.attribution(lambda k: tasks.where(F.col("task") % 3 == k % 3), folder, "ts", "level"), folder).awaitTermination()
    return polled(spark, folder, "event_id long, source long, attribution string, task long, batch int").select("event_id", "attribution", "task", "batch")


def once_within(spark, sf_dir):
    """Every event comes a second time, ten days later."""
    e = table(spark, sf_dir, "events").select("event_id", "ts").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    replay, folder = Replay(e, _tenth() + F.col("copy"), 4), new_folder(spark)
    for _ in replay.steps():
        found = run_now(events.once_within(replay.stream(), "event_id", "ts", "5 days").select("event_id"), folder=folder)
    return found


def compacted_by_loop(spark, sf_dir):
    folder = new_folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    replay = Replay(e, F.col("event_id") % 3, 3)
    for _ in replay.steps():
        poll(replay.stream(), events.compaction(folder, e, "user_id", "ts", "event_id", 10), folder).awaitTermination()
    return events.compacted(spark, folder, e, "user_id").select("event_id", "user_id")


def attributed(spark, sf_dir):
    starts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("1970-01-01")).otherwise("2999-01-01").cast("timestamp_ntz").alias("started_at"))
    return run_now(events.attributed(_stream(spark, sf_dir), starts, "user_id", "ts").select("event_id", "user_id"))


def once(spark, sf_dir):
    return run_now(events.once(_stream(spark, sf_dir).select("user_id"), "user_id"))


def owners(spark, sf_dir):
    tasks = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("task")).where("n_regionkey < 2 or n_nationkey < 5")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 6).cast("int").alias("source"))
    return events.single_owner(rows, tasks)


def compacted(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return events.compact(e.where("event_id % 2 = 0"), e.where("event_id % 3 <> 0"), "user_id", "ts", "event_id", 10).select("event_id", "user_id")


def all_compacted(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return events.compact(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0 or event_id % 3 = 0"), "user_id", "ts", "event_id", 10).select("event_id", "user_id")


def tail(spark, sf_dir):
    return events.tail(collection(spark, sf_dir, "log_lines"), 5).select("source", "seq")


def observed_in_parts(spark, sf_dir):
    """Logs that grow in three steps: what the last observation knows, and the phase changes of all of them."""
    folder = new_folder(spark)
    lines = collection(spark, sf_dir, "log_lines")
    most = lines.agg(F.max("seq")).first()[0] + 1
    replay = Replay(lines, F.floor(F.col("seq") * 3 / most).cast("int"), 3)
    for _ in replay.steps():
        poll(replay.stream(), logs.observer(folder), folder).awaitTermination()
    counts = polled(spark, folder, "source long, n_progress long, n_changes long, n_business long, batch int").groupBy("source").agg(*(F.sum(c).alias(c) for c in ("n_progress", "n_changes", "n_business")))
    return counts.join(logs.state(spark, folder, "long"), "source").select("source", "n_progress", "n_changes", "n_business", "context", "phase", "total_pages")


_TAIL = 300


def file_tails(spark, sf_dir):
    """Logs written as one file each; of each the last bytes are read."""
    folder = new_folder(spark)
    collection(spark, sf_dir, "log_lines").select("source", "seq", "line").repartition("source").sortWithinPartitions("source", "seq").select("source", "line").write.partitionBy("source").text(folder)
    return sources.log_tail(spark, folder, _TAIL).select(F.regexp_extract("path", r"source=(\d+)/", 1).cast("long").alias("source"), "size", "text")


QUERIES = {
    "r1_task_stream": (of_task, "SELECT event_id, event_type FROM events WHERE user_id = 3"),
    "r3_stream_changes_only": (
        changes,
        """SELECT event_id, user_id FROM (SELECT *, event_type || '|' || CAST(value > 50 AS VARCHAR) AS k FROM events)
           QUALIFY k IS DISTINCT FROM lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id)""",
    ),
    "r3_changes_over_batches": (changes_over_batches, """SELECT event_id, user_id FROM (SELECT *, event_type || '|' || CAST(value > 50 AS VARCHAR) AS k FROM events)
           QUALIFY k IS DISTINCT FROM lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id)"""),
    "s12_newest_of_streams": (newest_of_streams, "SELECT event_type AS stream, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500"),
    "r4_two_streams": (attributed_late, "SELECT e.event_id, e.user_id FROM events e JOIN (SELECT user_id, min(ts) + INTERVAL 1 HOUR AS begun FROM events GROUP BY user_id) s USING (user_id) WHERE ts >= begun"),
    "r6_once_within": (once_within, "SELECT event_id FROM events"),
    "r2_loop_of_compactions": (compacted_by_loop, "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10"),
    "r5_eligible_by_batch": (
        judged_by_batch,
        """WITH t AS (SELECT c_custkey % 25 AS source, c_custkey AS task, c_custkey % 2 = 0 AS later, c_custkey % 3 AS batch FROM customer WHERE c_custkey <= 60), o AS (SELECT batch, source, count(*) AS n, min(task) AS task, bool_or(later) AS later FROM t GROUP BY ALL),
           j AS (SELECT event_id, CAST(event_id % 3 AS INT) AS batch, CASE WHEN n IS NULL OR n <> 1 THEN 'unattributed' WHEN later THEN 'stale' WHEN event_id % 5 = 0 THEN 'api-noise' ELSE 'attributed' END AS attribution, task FROM events e LEFT JOIN o ON o.source = user_id % 25 AND o.batch = event_id % 3)
           SELECT event_id, attribution, CASE WHEN attribution = 'attributed' THEN task END AS task, batch FROM j""",
    ),
    "w4_w5_l6_observed_in_parts": (
        observed_in_parts,
        with_collections("log_lines", f"""WITH {ROWS}, {SUM}, l AS (SELECT source, arg_max(context, seq) AS context FROM c GROUP BY source) SELECT source, n_progress, n_changes, n_business, context, phase, total_pages FROM g JOIN l USING (source)"""),
    ),
    "s9_file_tails": (file_tails, with_collections("log_lines", f"WITH t AS (SELECT source, string_agg(line, chr(10) ORDER BY seq) || chr(10) AS text FROM log_lines GROUP BY source) SELECT source, strlen(text) AS size, right(text, {_TAIL}) AS text FROM t")),
    "r4_stream_attribution": (attributed, "SELECT event_id, user_id FROM events JOIN customer ON c_custkey = user_id WHERE c_custkey % 2 = 0"),
    "r5_single_owner": (
        owners,
        """WITH t AS (SELECT n_regionkey AS source, n_nationkey AS task FROM nation WHERE n_regionkey < 2 OR n_nationkey < 5), o AS (SELECT source, count(*) AS n, min(task) AS task FROM t GROUP BY source)
           SELECT event_id, CAST(user_id % 6 AS INT) AS source, CASE WHEN n = 1 THEN task END AS task FROM events LEFT JOIN o ON o.source = user_id % 6""",
    ),
    "r6_stream_once": (once, "SELECT DISTINCT user_id FROM events"),
    "r2_compaction_of_a_batch": (compacted, "SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 OR event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10"),
    "r2_compaction_of_all": (all_compacted, "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10"),
    "s9_log_tail": (tail, with_collections("log_lines", "SELECT source, seq FROM log_lines QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) <= 5")),
}
