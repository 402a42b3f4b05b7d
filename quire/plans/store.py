"""Mutations of keyed collections (M and S families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import catalog, store, tasks
from quire.plans.proxies import collection, with_collections
from quire.sources import table

_ACTIVE = ("uploading", "pending", "running", "ai-pending", "ai-running", "review-pending")


def _c(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _new(spark, sf_dir):
    """A change set: every third customer, and new ones."""
    c = _c(spark, sf_dir).where("c_custkey % 3 = 0")
    return c.select((F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 10_000_000)).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), F.when(F.col("c_custkey") % 4 == 0, F.lit(1.5)).alias("c_acctbal"), "c_mktsegment")


_NEW = "n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 10000000 END AS c_custkey, 'new ' || c_name AS c_name, CASE WHEN c_custkey % 4 = 0 THEN 1.5 END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 = 0), c AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer)"
_LINES = "l AS (SELECT o_custkey AS c_custkey, o_orderkey AS nr, CASE WHEN o_orderkey % 3 > 0 THEN 'n' || o_orderkey END AS c_name, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS c_acctbal, o_orderpriority AS c_mktsegment FROM orders)"
_SETTLE = """CASE WHEN state = 'completed' THEN '' ELSE error_message END AS error_message, CASE WHEN state = 'completed' AND error_message <> '' THEN error_message END AS previous_error"""


def _lines(spark, sf_dir):
    """Changes to customers, many to a key, in the order of ``nr``."""
    o = table(spark, sf_dir, "orders")
    return o.selectExpr("o_custkey AS c_custkey", "CASE WHEN o_orderkey % 3 > 0 THEN 'n' || o_orderkey END AS c_name", "CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS c_acctbal", "o_orderpriority AS c_mktsegment", "o_orderkey AS nr")


def settled(t):
    """Left-over errors of recovered tasks move aside."""
    done = F.col("state") == "completed"
    return t.select("id", F.when(done, "").otherwise(F.col("error_message")).alias("error_message"), F.when(done & (F.col("error_message") != ""), F.col("error_message")).alias("previous_error"))


def arrivals(spark, sf_dir):
    """New and known tasks in one batch, several of an owner."""
    t = collection(spark, sf_dir, "tasks")
    return store.insert_unless_active(t.where("seq % 4 = 0 or seq % 9 = 0").select("id", "material_id", "state", "created_at"), t.where("seq % 4 <> 0"), _ACTIVE).select("id", "conflict")


def reset_keys(spark, sf_dir):
    m = collection(spark, sf_dir, "tasks")
    meta = F.create_map(F.lit("mineruTaskId"), F.col("mineru_task_id"), F.lit("stage"), F.col("stage"), F.lit("submitRetries"), F.col("retries").cast("string"))
    got = store.without_keys(meta, ("mineruTaskId", "submitRetries"), F.create_map(F.lit("submitRetries"), F.lit("0")))
    return m.select("id", F.array_join(F.array_sort(F.transform(F.map_entries(got), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("metadata"))


QUERIES = {
    "m1_upsert": (lambda s, d: store.upsert(_c(s, d), _new(s, d), "c_custkey"), f"WITH {_NEW} SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n"),
    "m2_patch": (
        lambda s, d: store.patch(_c(s, d), _new(s, d), ["c_name", "c_acctbal"], "c_custkey"),
        f"WITH {_NEW} SELECT c.c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, c.c_mktsegment FROM c LEFT JOIN n USING (c_custkey)",
    ),
    "m4_merge_put": (
        lambda s, d: store.patch(_c(s, d), _new(s, d), ["c_name", "c_acctbal"], "c_custkey", insert=True),
        f"WITH {_NEW} SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, c.c_mktsegment FROM c FULL JOIN n ON c.c_custkey = n.c_custkey",
    ),
    "m1_last_of_several": (
        lambda s, d: store.upsert(_c(s, d), _lines(s, d), "c_custkey", "nr").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"),
        f"""WITH {_LINES}, u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY nr DESC) = 1)
        SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM u UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u)""",
    ),
    "m2_last_of_several": (
        lambda s, d: store.patch(_c(s, d), _lines(s, d), ["c_name", "c_acctbal"], "c_custkey", order="nr"),
        f"""WITH {_LINES}, u AS (SELECT c_custkey, arg_max(c_name, nr) FILTER (c_name IS NOT NULL) AS c_name, arg_max(c_acctbal, nr) FILTER (c_acctbal IS NOT NULL) AS c_acctbal FROM l GROUP BY 1)
        SELECT c.c_custkey, coalesce(u.c_name, c.c_name) AS c_name, coalesce(u.c_acctbal, c.c_acctbal) AS c_acctbal, c_mktsegment FROM customer c LEFT JOIN u USING (c_custkey)""",
    ),
    "m3_bulk_patch": (
        lambda s, d: store.bulk_patch(_c(s, d), _c(s, d).where("c_custkey % 10 = 1"), {"c_mktsegment": F.lit("X"), "c_custkey": F.lit(0)}, "c_custkey"),
        "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 10 = 1 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    ),
    "m5_protected_merge": (
        lambda s, d: collection(s, d, "tasks").select("id", store.protected(F.col("message"), F.col("error_message")).alias("value")),
        with_collections("tasks", "SELECT id, CASE WHEN coalesce(error_message, '') = '' THEN message ELSE error_message END AS value FROM tasks"),
    ),
    "m6_m7_delete": (
        lambda s, d: store.delete(collection(s, d, "tasks"), collection(s, d, "materials").where("subject = 'BUILDING'"), foreign="material_id").select("id"),
        with_collections("tasks materials", "SELECT id FROM tasks WHERE material_id NOT IN (SELECT id FROM materials WHERE subject = 'BUILDING')"),
    ),
    "m8_cascade_dry_run": (
        lambda s, d: store.cascade(collection(s, d, "materials").where("subject = 'BUILDING'"), collection(s, d, "tasks"), collection(s, d, "jobs"), ("running", "ai-running")),
        with_collections(
            "materials tasks jobs",
            """WITH ids AS (SELECT id FROM materials WHERE subject = 'BUILDING'), own AS (SELECT * FROM tasks WHERE material_id IN (SELECT id FROM ids))
            SELECT (SELECT count(*) FROM ids) AS materials, (SELECT count(*) FROM own) AS tasks, (SELECT count(*) FROM own WHERE state IN ('running', 'ai-running')) AS running,
              (SELECT count(*) FROM jobs WHERE parse_task_id IN (SELECT id FROM own)) AS jobs, (SELECT count(*) FROM own WHERE state IN ('running', 'ai-running')) > 0 AS blocked""",
        ),
    ),
    "m9_products_of_deleted": (
        lambda s, d: collection(s, d, "materials").where(~F.arrays_overlap(F.split("tags", ","), F.array(F.lit("building"), F.lit("n3")))).select("id"),
        with_collections("materials", "SELECT id FROM materials WHERE NOT list_has_any(string_split(tags, ','), ['building', 'n3'])"),
    ),
    "m10_insert_unless_active": (
        lambda s, d: store.insert_unless_active(collection(s, d, "materials").select(F.concat(F.lit("new "), "id").alias("id"), F.col("id").alias("material_id"), F.lit("pending").alias("state"), F.lit(0).alias("created_at")), collection(s, d, "tasks"), _ACTIVE).select("material_id", "conflict"),
        with_collections("materials tasks", f"SELECT id AS material_id, id IN (SELECT material_id FROM tasks WHERE state IN {_ACTIVE}) AS conflict FROM materials"),
    ),
    "m10_batch_of_tasks": (
        arrivals,
        with_collections(
            "tasks",
            f"""WITH t AS (SELECT * FROM tasks WHERE seq % 4 <> 0), busy AS (SELECT DISTINCT material_id FROM t WHERE state IN {_ACTIVE}), i AS (SELECT id, material_id, state, created_at, state IN {_ACTIVE} AS active FROM tasks WHERE seq % 4 = 0 OR seq % 9 = 0),
            k AS (SELECT *, coalesce(bool_or(active) OVER (PARTITION BY material_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM i)
            SELECT id, material_id <> '' AND id NOT IN (SELECT id FROM t) AND (earlier OR material_id IN (SELECT material_id FROM busy)) AS conflict FROM k""",
        ),
    ),
    "m12_reset_metadata": (reset_keys, with_collections("tasks", "SELECT id, 'stage=' || stage || ';submitRetries=0' AS metadata FROM tasks")),
    "m13_differential_upsert": (
        lambda s, d: store.changed(store.upsert(_c(s, d), _new(s, d), "c_custkey").where("c_custkey % 5 <> 0"), _c(s, d), "c_custkey"),
        f"""WITH {_NEW}, u AS (SELECT * FROM (SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n) WHERE c_custkey % 5 <> 0)
        SELECT coalesce(u.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'insert' WHEN u.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS change FROM u FULL JOIN c ON u.c_custkey = c.c_custkey
        WHERE c.c_custkey IS NULL OR u.c_custkey IS NULL OR (u.c_name, u.c_acctbal, u.c_mktsegment) IS DISTINCT FROM (c.c_name, c.c_acctbal, c.c_mktsegment)""",
    ),
    "m14_clear_recovered_errors": (lambda s, d: settled(collection(s, d, "tasks")), with_collections("tasks", f"SELECT id, {_SETTLE} FROM tasks")),
    "m15_clear_residue": (
        lambda s, d: store.residue(collection(s, d, "materials")),
        with_collections("materials", "SELECT id, CASE ai_status WHEN 'analyzed' THEN 'completed' WHEN 'failed' THEN 'ai-failed' ELSE 'mineru-completed' END AS stage FROM materials WHERE status = 'completed' AND mineru_status = 'processing'"),
    ),
    "s7_restore_missing": (lambda s, d: store.insert_missing(_c(s, d), _new(s, d), "c_custkey"), f"WITH {_NEW} SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM c)"),
    "s5_collection_totals": (
        lambda s, d: store.totals({n: table(s, d, n) for n in ("customer", "orders", "events")}),
        "SELECT 'customer' AS collection, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events",
    ),
    "s11_manifest": (
        lambda s, d: catalog.manifest(collection(s, d, "objects")),
        with_collections("objects", "SELECT owner, string_agg(nr || ':' || name || ':' || size, '|' ORDER BY nr || ':' || name || ':' || size) AS manifest FROM objects GROUP BY owner"),
    ),
    "s10_archive_entries": (
        lambda s, d: catalog.archive_files(collection(s, d, "objects").select("owner", F.col("name").alias("entry")).where(F.col("entry").contains("/"))),
        with_collections("objects", "SELECT owner, name AS entry FROM objects WHERE NOT ends_with(name, '/') AND contains(name, '/')"),
    ),
    "j9_startup_sync": (
        lambda s, d: tasks.confirmed_at_startup(*(collection(s, d, n) for n in ("materials", "tasks", "jobs"))),
        with_collections(
            "materials tasks jobs",
            """SELECT m.id, t.id AS task_id, j.id AS job_id FROM (SELECT * FROM jobs WHERE parse_task_id <> '' QUALIFY row_number() OVER (PARTITION BY parse_task_id ORDER BY seq DESC) = 1) j
            JOIN tasks t ON t.id = j.parse_task_id AND t.state = 'completed' JOIN materials m ON m.id = t.material_id WHERE j.state = 'confirmed'""",
        ),
    ),
}
