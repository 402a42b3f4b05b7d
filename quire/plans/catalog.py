"""Catalog queries over the stand-ins (F, O, A, S and U families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import blank, is_flag
from quire.operators import catalog, store, tasks
from quire.plans.proxies import collection, with_collections
from quire.sources import table


def _m(spark, sf_dir):
    return collection(spark, sf_dir, "materials")


def _q(names, fields, run, body):
    """A query from a frame function over one stand-in and its SQL."""
    first = names.split()[0]
    return (lambda spark, sf_dir: run(collection(spark, sf_dir, first)).select(*fields), with_collections(names, body))


#: What stands for each of the eleven collections.
_ELEVEN = ("materials", "customer", "orders", "lineitem", "tasks", "jobs", "events", "part", "supplier", "nation", "region")


def _eleven(spark, sf_dir):
    return [collection(spark, sf_dir, t) if t in ("materials", "tasks", "jobs") else table(spark, sf_dir, t) for t in _ELEVEN]


_PRODUCTS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 > 0 THEN p_partkey * 7919 % 1009 END AS created_at, p_partkey * 31 % 97 AS use_count, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END AS rating FROM part"


def _products(spark, sf_dir):
    return spark.sql(_PRODUCTS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def reset(spark, sf_dir):
    orphans = collection(spark, sf_dir, "objects").where("startswith(name, 'loose')")
    return catalog.reset_counts(collection(spark, sf_dir, "drafts"), collection(spark, sf_dir, "runs"), table(spark, sf_dir, "events"), collection(spark, sf_dir, "jobs"), table(spark, sf_dir, "part"), orphans)


QUERIES = {
    "s3_scan": (lambda s, d: table(s, d, "nation"), "SELECT * FROM nation"),
    "s4_point_lookup": _q("materials", ["id", "title"], lambda m: m.where(F.col("id") == "8"), "SELECT id, title FROM materials WHERE id = '8'"),
    "s8_object_prefix": _q("objects", ["name", "size", "nr", "owner"], lambda o: o.where(F.col("name").startswith("originals/8/")), "SELECT name, size, nr, owner FROM objects WHERE starts_with(name, 'originals/8/')"),
    "f1_equality": _q("materials", ["id", "subject"], lambda m: catalog.equals(m, subject="BUILDING", status="all", mineru_status="completed"), "SELECT id, subject FROM materials WHERE subject = 'BUILDING' AND mineru_status = 'completed'"),
    "f2_search": _q(
        "materials", ["id", "title"], lambda m: catalog.search(m.withColumn("tag_list", F.split("tags", ",")), "  N1 ", ["title", "subject"], ("tag_list",)),
        "SELECT id, title FROM materials WHERE contains(lower(title), 'n1') OR contains(lower(coalesce(subject, '')), 'n1') OR len(list_filter(string_split(tags, ','), lambda t: contains(lower(t), 'n1'))) > 0",
    ),
    "f3_f4_search_with_severity": _q("tasks", ["id"], lambda t: catalog.search(catalog.equals(t, state="failed"), "T1", ["id", "message", "stage"]), "SELECT id FROM tasks WHERE state = 'failed' AND (contains(lower(id), 't1') OR contains(lower(message), 't1') OR contains(lower(stage), 't1'))"),
    "f6_json_paths": (
        lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing")),
        "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events",
    ),
    "f9_a10_live_counts": _q(
        "tasks", ["*"], tasks.live_counts,
        "SELECT count(*) AS live, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'ai-pending') AS ai_pending, count(*) FILTER (state = 'ai-running') AS ai_running FROM tasks WHERE state IN ('pending', 'running', 'ai-pending', 'ai-running')",
    ),
    "f11_foreign_key": _q("tasks", ["id", "material_id"], lambda t: t.where(F.col("material_id") == "10"), "SELECT id, material_id FROM tasks WHERE material_id = '10'"),
    "f14_heavy_field_to_count": (
        lambda s, d: catalog.without_list(_m(s, d).select("id", F.when(F.col("tags") != "", F.split("tags", ",")).alias("tag_list")), "tag_list", "n_tags"),
        with_collections("materials", "SELECT id, CAST(CASE WHEN tags = '' THEN 0 ELSE len(string_split(tags, ',')) END AS INT) AS n_tags FROM materials"),
    ),
    "f15_key_prefix": _q(
        "materials", ["*"], catalog.bad_paths,
        "SELECT id, NOT starts_with(object_name, 'originals/' || id || '/') AS bad_original, coalesce(markdown_object_name, '') <> '' AND NOT starts_with(markdown_object_name, 'parsed/' || id || '/') AS bad_parsed FROM materials",
    ),
    "f16_f17_allow_lists": _q("objects", ["name", "nr", "owner"], lambda o: o.where(F.lower(F.substring_index("name", ".", -1)).isin("pdf", "md")), "SELECT name, nr, owner FROM objects WHERE lower(list_extract(string_split(name, '.'), -1)) IN ('pdf', 'md')"),
    "f18_s12_last_rows": (
        lambda s, d: catalog.last_rows(table(s, d, "events").where("ts >= timestamp'1997-01-01' and event_type = 'click'"), "ts", "event_id", 40).select("event_id", "user_id"),
        "SELECT event_id, user_id FROM (SELECT * FROM events WHERE ts >= TIMESTAMP '1997-01-01' AND event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 40)",
    ),
    "o1_newest_first": (
        lambda s, d: catalog.newest_first(_m(s, d)).select("id", "update_time", "create_time").limit(60),
        with_collections("materials", "SELECT id, update_time, create_time FROM materials ORDER BY coalesce(update_time, 0) DESC, coalesce(create_time, 0) DESC, id DESC LIMIT 60"),
    ),
    "o2_by_size": (lambda s, d: catalog.ordered(_m(s, d), "size").select("id", "size_bytes").limit(25), with_collections("materials", "SELECT id, size_bytes FROM materials ORDER BY coalesce(size_bytes, 0) DESC, id LIMIT 25")),
    "o3_products": (lambda s, d: table(s, d, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").select("p_partkey", "p_retailprice").limit(30), "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30"),
    "o4_o11_tasks_of_material": _q("tasks", ["id", "created_at"], lambda t: t.where(F.col("material_id") == "10").orderBy(F.col("created_at").desc_nulls_last(), "id").limit(5), "SELECT id, created_at FROM tasks WHERE material_id = '10' ORDER BY created_at DESC NULLS LAST, id LIMIT 5"),
    "o5_events_of_task": (lambda s, d: table(s, d, "events").where("user_id = 3").orderBy("ts", "event_id").select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE user_id = 3"),
    "o6_numeric_ids": (lambda s, d: table(s, d, "supplier").orderBy(F.col("s_suppkey").desc()).limit(9).select("s_suppkey"), "SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 9"),
    "o8_provider_pick": (
        lambda s, d: catalog.first_provider(table(s, d, "nation"), F.col("n_regionkey") != 0, F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")), "n_name").select("n_name"),
        "SELECT n_name FROM nation WHERE n_regionkey <> 0 ORDER BY coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END, 999), n_name LIMIT 1",
    ),
    "o9_o10_page": (lambda s, d: catalog.page(table(s, d, "part").orderBy("p_name", "p_partkey"), 3, 12).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 12 OFFSET 24"),
    "o9_page_count": (lambda s, d: catalog.page_count(_m(s, d)), with_collections("materials", "SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 12) AS BIGINT)) AS pages FROM materials")),
    "a1_status_counts": (lambda s, d: catalog.count_by(_m(s, d), F.col("status"), "unknown"), with_collections("materials", "SELECT coalesce(nullif(status, ''), 'unknown') AS value, count(*) AS n FROM materials GROUP BY 1")),
    "a1_subject_counts": (lambda s, d: catalog.count_by(_m(s, d), F.col("subject"), "未标注"), with_collections("materials", "SELECT coalesce(nullif(subject, ''), '未标注') AS value, count(*) AS n FROM materials GROUP BY 1")),
    "a2_a5_tab_counts": (
        lambda s, d: catalog.counts_of(_m(s, d), "status", ("processing", "completed", "failed", "reviewing", "archived")),
        with_collections("materials", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{v}') AS n_{v}" for v in ("processing", "completed", "failed", "reviewing", "archived")) + " FROM materials"),
    ),
    "a3_totals_of_filtered": (
        lambda s, d: catalog.totals(catalog.equals(_m(s, d), mineru_status="completed"), "size_bytes", "subject"),
        with_collections("materials", "SELECT CAST(coalesce(sum(coalesce(size_bytes, 0)), 0) AS BIGINT) AS bytes, count(DISTINCT nullif(subject, '')) AS labels FROM materials WHERE mineru_status = 'completed'"),
    ),
    "a7_storage": (lambda s, d: catalog.storage(collection(s, d, "objects")), with_collections("objects", "SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM objects GROUP BY ROLLUP (bucket)")),
    "a12_facet_values": (lambda s, d: catalog.facet(_m(s, d), "subject"), with_collections("materials", "SELECT DISTINCT trim(subject) AS value FROM materials WHERE trim(subject) <> ''")),
    "a13_grouped_any": (
        lambda s, d: tasks.jobs_of_tasks(collection(s, d, "jobs")).withColumn("ids", F.array_join("ids", ",")),
        with_collections("jobs", "SELECT parse_task_id, string_agg(id, ',' ORDER BY id) AS ids, bool_or(state IN ('pending', 'running')) AS active FROM jobs WHERE parse_task_id <> '' GROUP BY parse_task_id"),
    ),
    "a14_reset_counts": (
        lambda s, d: _m(s, d).agg(F.count("*").alias("materials"), F.count_if(~blank(F.col("ai_job_id"))).alias("with_job"), F.count_if(~F.col("object_name").startswith("originals/")).alias("path_drift")),
        with_collections("materials", "SELECT count(*) AS materials, count(*) FILTER (ai_job_id <> '') AS with_job, count(*) FILTER (NOT starts_with(object_name, 'originals/')) AS path_drift FROM materials"),
    ),
    "a14_whole_reset_counts": (
        reset,
        with_collections(
            "drafts runs jobs objects",
            """WITH o AS (SELECT bucket, size FROM objects WHERE starts_with(name, 'loose')), m AS (SELECT metadata FROM drafts), meta AS (SELECT 'm' AS kind, NULL AS state, NULL AS stage, metadata FROM m UNION ALL SELECT 't', state, stage, metadata FROM runs),
            f AS (SELECT kind, state, stage, coalesce(metadata ->> '$.objectName', '') <> '' AS original, coalesce(metadata ->> '$.markdownObjectName', '') <> '' OR coalesce(metadata ->> '$.zipObjectName', '') <> '' AS result, coalesce(metadata ->> '$.canceledAt', '') <> '' AS canceled FROM meta)
            SELECT count(*) FILTER (kind = 'm') AS materials, count(*) FILTER (kind = 't') AS tasks, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM part) AS asset_details, count(*) FILTER (kind = 'm' AND original) AS originals,
              count(*) FILTER (result) AS parsed, (SELECT count(*) FROM o) AS orphans, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM o) AS orphan_bytes, (SELECT coalesce(string_agg(DISTINCT bucket, ',' ORDER BY bucket), '') FROM o) AS orphan_buckets,
              count(*) FILTER (kind = 't' AND canceled AND state <> 'canceled') AS drifted, count(*) FILTER (kind = 't' AND NOT canceled AND (state IN ('running', 'ai-running', 'result-store') OR stage IN ('mineru-processing', 'mineru-queued'))) AS running FROM f""",
        ),
    ),
    "a1_all_counts": (
        lambda s, d: catalog.statistics(_m(s, d), "size_bytes", dict(zip(store.COLLECTIONS, _eleven(s, d), strict=True))),
        with_collections(
            "materials tasks jobs",
            "SELECT (SELECT CAST(coalesce(sum(coalesce(size_bytes, 0)), 0) AS BIGINT) FROM materials) AS bytes, " + ", ".join(f'(SELECT count(*) FROM {t}) AS "{c}"' for c, t in zip(store.COLLECTIONS, _ELEVEN, strict=True)),
        ),
    ),
    "o3_newest_products": (lambda s, d: catalog.products_ordered(_products(s, d), "newest"), f"SELECT * FROM ({_PRODUCTS}) ORDER BY created_at DESC NULLS LAST, id"),
    "o3_most_used_products": (lambda s, d: catalog.products_ordered(_products(s, d), "most used"), f"SELECT * FROM ({_PRODUCTS}) ORDER BY use_count DESC NULLS LAST, id"),
    "o3_best_rated_products": (lambda s, d: catalog.products_ordered(_products(s, d), "best rated"), f"SELECT * FROM ({_PRODUCTS}) ORDER BY rating DESC NULLS LAST, id"),
    "u1_bag_union": (
        lambda s, d: table(s, d, "customer").select(F.col("c_name").alias("name"), "c_acctbal").unionByName(table(s, d, "supplier").select(F.col("s_name").alias("name")), allowMissingColumns=True),
        "SELECT c_name AS name, c_acctbal FROM customer UNION ALL SELECT s_name, NULL FROM supplier",
    ),
    "u3_distinct_ids": (
        lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("id")).union(table(s, d, "customer").select("c_custkey")).union(table(s, d, "supplier").select("s_suppkey")).distinct(),
        "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier",
    ),
    "u4_ids_gone": (lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(s, d, "orders").select("o_custkey")), "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "d_flag_texts": _q("materials", ["*"], lambda m: m.select("id", is_flag(F.col("parsed_files_count")).alias("flag")), "SELECT id, coalesce(parsed_files_count IN ('true', '1'), false) AS flag FROM materials"),
    # the whole sorts; what ends in a limit above is a report's first rows
    "o1_all_newest_first": (
        lambda s, d: catalog.newest_first(_m(s, d)).select("id", "update_time", "create_time"),
        with_collections("materials", "SELECT id, update_time, create_time FROM materials ORDER BY coalesce(update_time, 0) DESC, coalesce(create_time, 0) DESC, id DESC"),
    ),
    "o2_all_by_size": (lambda s, d: catalog.ordered(_m(s, d), "size").select("id", "size_bytes"), with_collections("materials", "SELECT id, size_bytes FROM materials ORDER BY coalesce(size_bytes, 0) DESC, id")),
    "o3_all_products": (lambda s, d: table(s, d, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").select("p_partkey", "p_retailprice"), "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey"),
    "o4_all_tasks": _q("tasks", ["id", "created_at"], catalog.tasks_newest_first, "SELECT id, created_at FROM tasks ORDER BY created_at DESC NULLS LAST, id"),
    "o6_all_numeric_ids": (lambda s, d: table(s, d, "supplier").orderBy(F.col("s_suppkey").desc()).select("s_suppkey"), "SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC"),
}
