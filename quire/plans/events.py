"""Event-log compaction over ``events`` (user_id stands for the task, props for the payload)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import events
from quire.sources import table


def _e(spark, sf_dir):
    return table(spark, sf_dir, "events")


def keep_latest(spark, sf_dir):
    return events.keep_latest(_e(spark, sf_dir), "user_id", "ts", "event_id", 50)


def first_clicks(spark, sf_dir):
    return events.first_of_kind(_e(spark, sf_dir), "user_id", "event_type", "click", "ts", "event_id").select("event_id", "user_id", "event_type")


def changes(spark, sf_dir):
    return events.changes_only(_e(spark, sf_dir), "user_id", "ts", "event_id", [F.col("event_type"), F.col("value") > 50]).select("event_id", "user_id")


def dedup(spark, sf_dir):
    return events.latest_per_key(_e(spark, sf_dir), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 400, [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id", "event_type")


def slimmed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    payload = F.to_json(F.struct(F.col("text").alias("error"), F.col("role").alias("stage"), F.col("text").alias("metadata")))
    kept = events.slim(payload, 2048, ("error", "stage"))
    back = F.get_json_object(kept["payload"], "$.error")
    return c.select("conv_id", "turn", kept["truncated"].alias("truncated"), F.length(back).alias("error_chars"), F.get_json_object(kept["payload"], "$.metadata").isNull().alias("metadata_gone"))


_PAYLOAD = "to_json({'error': text, 'stage': role, 'metadata': text})"
QUERIES = {
    "w1_keep_latest_events": (
        keep_latest,
        """SELECT event_id, ts, user_id, event_type, value, props FROM events
           QUALIFY row_number() OVER (PARTITION BY coalesce(CAST(user_id AS VARCHAR), '_global') ORDER BY ts DESC, event_id DESC) <= 50""",
    ),
    "w2_first_of_kind": (first_clicks, "SELECT event_id, user_id, event_type FROM events QUALIFY event_type <> 'click' OR row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id) = 1"),
    "w6_changes_only": (
        changes,
        """SELECT event_id, user_id FROM (SELECT *, event_type || '|' || CAST(value > 50 AS VARCHAR) AS k FROM events)
           QUALIFY k IS DISTINCT FROM lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id)""",
    ),
    "w7_latest_per_key": (
        dedup,
        "SELECT event_id, user_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) ORDER BY ts DESC, event_id DESC LIMIT 400",
    ),
    "n10_slim_payload": (
        slimmed,
        """SELECT conv_id, turn, strlen_chars > 2048 AS truncated, CAST(CASE WHEN strlen_chars > 2048 THEN least(500, length(text)) ELSE length(text) END AS INT) AS error_chars, strlen_chars > 2048 AS metadata_gone
           FROM (SELECT *, 2 * length(replace(replace(replace(text, chr(92), 'xx'), '"', 'xx'), chr(10), 'xx')) + length(role) + 37 AS strlen_chars FROM conversations)""",
    ),
}
