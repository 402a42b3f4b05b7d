"""Rules over open JSON: task sets, merges, migration, model output (F, M, A, B, N and X families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import catalog, events, semistructured, status, store, tasks, text
from quire.plans.proxies import collection, with_collections
from quire.sources import table


def _of(name, run):
    """A query from a frame function over one stand-in."""
    return lambda spark, sf_dir: run(collection(spark, sf_dir, name))


def _fields(named):
    return [c.alias(k) for k, c in named.items()]


def _j(path, column="metadata"):
    return f"json_extract_string({column}, '$.{path}')"


_LOCAL = f"engine = 'local-mineru' AND coalesce({_j('canceledAt')}, '') = ''"
_EXTERNAL = f"coalesce({_j('mineruTaskId')}, '') <> ''"
_UNCOUNTED = f"coalesce({_j('parsedFilesCount')}, '0') = '0'"
_RETRY = "(stage = 'submit-failed-retryable' OR contains(message, '可重试'))"
_SETS = f"""s AS (SELECT *, {_LOCAL} AND state = 'running' AND {_EXTERNAL} AND stage IN ('mineru-processing', 'mineru-queued', 'result-fetching') AS running_external,
  {_LOCAL} AND {_EXTERNAL} AND (state = 'pending' OR (state = 'running' AND stage IN ('upload', 'process'))) AS drifting,
  {_LOCAL} AND state <> 'canceled' AND {_EXTERNAL} AND coalesce({_j("mineruStatus")} = 'completed', false) AND {_UNCOUNTED} AS not_ingested,
  {_LOCAL} AND state <> 'canceled' AND {_RETRY} AS retryable,
  {_LOCAL} AND coalesce({_j("mineruStatus")} = 'completed', false) AND ((state = 'failed' AND {_EXTERNAL}) OR (state = 'running' AND stage = 'mineru-processing')) AS takeover FROM runs)"""
_RAW = "CASE seq % 9 WHEN 0 THEN 'Done' WHEN 1 THEN 'error' WHEN 2 THEN 'queued' WHEN 3 THEN 'running' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'not_found' WHEN 6 THEN 'strange' WHEN 7 THEN 'pending' END"
_ERROR = "CASE seq % 7 WHEN 0 THEN 'x split_with_sizes y' WHEN 1 THEN 'MPS backend out of memory (' || seq || ')' WHEN 2 THEN 'Image features and image tokens do not match' WHEN 3 THEN 'split with sizes' WHEN 4 THEN NULL ELSE message END"


def _patches(spark, sf_dir):
    r = collection(spark, sf_dir, "runs")
    return r.where("seq % 3 = 0").selectExpr("id", """concat('{"stage":', IF(seq % 2 = 0, 'null', '"new"'), IF(seq % 4 = 0, ',"message":"said"', ''), IF(seq % 5 = 0, '', ',"metadata":{"mineruStatus":null,"extra":7}'), '}') AS body""")


def _patched(spark, sf_dir, insert):
    r = collection(spark, sf_dir, "runs").select("id", "seq", "stage", "message", "metadata")
    base = r.where("seq % 6 <> 3") if insert else r
    got = store.patch_json(base.drop("seq"), _patches(spark, sf_dir), insert=insert)
    return got.select("id", "stage", "message", *(F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("keep", "mineruTaskId", "mineruStatus", "extra")))


def _patch_sql(insert):
    old = "seq % 6 <> 3" if insert else "true"
    merged = "seq % 3 = 0 AND seq % 5 <> 0"
    was = lambda c: f"CASE WHEN {old} THEN {c} END"
    meta = lambda k: was(_j(k))
    return with_collections(
        "runs",
        f"""SELECT id, CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 <> 0 THEN 'new' END ELSE {was("stage")} END AS stage, CASE WHEN seq % 12 = 0 THEN 'said' ELSE {was("message")} END AS message,
        {meta("keep")} AS keep, {meta("mineruTaskId")} AS "mineruTaskId", CASE WHEN {merged} THEN NULL ELSE {meta("mineruStatus")} END AS "mineruStatus", CASE WHEN {merged} THEN '7' END AS extra FROM runs""",
    )


_META = ("keep", "mineruTaskId", "mineruStatus", "extra")


def _patches_in_order(spark, sf_dir, insert):
    """Several bodies a key, some of them unreadable, over metadata of which some is cut off."""
    r = collection(spark, sf_dir, "runs").select("id", "seq", "stage", "message", F.expr("IF(seq % 13 = 0, left(metadata, 9), metadata)").alias("metadata"))
    base = (r.where("seq % 6 <> 3") if insert else r).drop("seq")
    got = store.patch_json(base, collection(spark, sf_dir, "patches"), insert=insert, order="nr")
    shown = got.select("id", "stage", "message", "metadata", F.json_tuple("metadata", *_META).alias(*_META))
    # metadata that gave a field was read to its end
    unread = F.when(F.coalesce(*_META).isNull() & F.get_json_object("metadata", "$").isNull(), F.col("metadata"))
    return shown.select("id", "stage", "message", unread.alias("unread"), *_META)


def _in_order_sql(insert):
    reset = "NULL" if insert else "max(nr)"
    row = "coalesce(r.id, q.id)" if insert else "r.id"
    joins = (f"FULL JOIN (SELECT DISTINCT id FROM e) q ON q.id = r.id " if insert else "") + " ".join(f"LEFT JOIN {x} ON {x}.id = {row}" for x in "tnx")
    old = lambda k: f"json_extract_string(CASE WHEN NOT cut THEN metadata END, '$.{k}')"
    meta = lambda k: f"""CASE WHEN list_contains(names, '{k}') AND NOT (reset IS NULL AND cut) THEN {k}_new WHEN reset IS NULL AND NOT cut THEN {old(k)} END AS "{k}" """
    return with_collections(
        "runs patches",
        f"""WITH r AS (SELECT id, stage, message, CASE WHEN seq % 13 = 0 THEN left(metadata, 9) ELSE metadata END AS metadata, seq % 13 = 0 AS cut FROM runs {"WHERE seq % 6 <> 3" if insert else ""}),
        e AS (SELECT p.id, p.nr * 1000 + j.id AS nr, j.key, j.value, j.type FROM (SELECT id, nr, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body ELSE '{{}}' END AS body FROM patches) p, json_each(p.body) j),
        x AS (SELECT id, {reset} AS reset, arg_max_null(value ->> '$', nr) AS instead FROM e WHERE key = 'metadata' AND type <> 'OBJECT' GROUP BY id),
        m AS (SELECT e.id, e.nr, j.key, j.value ->> '$' AS value FROM (SELECT e.* FROM e LEFT JOIN x USING (id) WHERE key = 'metadata' AND type = 'OBJECT' AND nr > coalesce(reset, -1)) e, json_each(e.value) j),
        n AS (SELECT id, list(DISTINCT key) AS names, {", ".join(f"arg_max_null(value, nr) FILTER (key = '{k}') AS {k}_new" for k in _META)} FROM m GROUP BY id),
        t AS (SELECT id, count(*) FILTER (key = 'stage') AS stages, arg_max_null(value ->> '$', nr) FILTER (key = 'stage') AS stage_new, count(*) FILTER (key = 'message') AS messages, arg_max_null(value ->> '$', nr) FILTER (key = 'message') AS message_new FROM e GROUP BY id),
        k AS (SELECT {row} AS id, coalesce(cut, false) AS cut, metadata, stage, message, stages, stage_new, messages, message_new, coalesce(names, []) AS names, reset, instead, {", ".join(f"{k}_new" for k in _META)} FROM r {joins})
        SELECT id, CASE WHEN stages > 0 THEN stage_new ELSE stage END AS stage, CASE WHEN messages > 0 THEN message_new ELSE message END AS message,
          CASE WHEN reset IS NOT NULL AND len(names) = 0 THEN instead WHEN reset IS NULL AND cut THEN metadata END AS unread, {", ".join(map(meta, _META))} FROM k""",
    )


def profiles(runs):
    old = F.expr("""CASE WHEN seq % 5 = 0 THEN '{"a":1}' ELSE concat('{"a":1,"mineruExecutionProfile":{"parseMethod":"auto","maxPages":', seq, ',"note":"old"}}') END""")
    new = F.expr("""CASE seq % 4 WHEN 0 THEN '{"mineruExecutionProfile":{"parseMethod":"","note":""}}' WHEN 1 THEN '{"b":2,"mineruExecutionProfile":{"parseMethod":null,"maxPages":5}}'
        WHEN 2 THEN '{"mineruExecutionProfile":{"parseMethod":"ocr","note":null}}' ELSE '{"a":null}' END""")
    got = runs.select("id", store.task_metadata(old, new).alias("m"))
    return got.select("id", *(F.get_json_object("m", f"$.{p}").alias(n) for n, p in (("a", "a"), ("b", "b"), ("method", f"{store.PROFILE}.parseMethod"), ("pages", f"{store.PROFILE}.maxPages"), ("note", f"{store.PROFILE}.note"))))


_PROFILES = """SELECT id, CASE WHEN seq % 4 <> 3 THEN '1' END AS a, CASE WHEN seq % 4 = 1 THEN '2' END AS b,
  CASE seq % 4 WHEN 2 THEN 'ocr' WHEN 0 THEN CASE WHEN seq % 5 = 0 THEN '' ELSE 'auto' END ELSE CASE WHEN seq % 5 <> 0 THEN 'auto' END END AS method,
  CASE WHEN seq % 4 = 1 THEN '5' WHEN seq % 5 <> 0 THEN CAST(seq AS VARCHAR) END AS pages,
  CASE WHEN seq % 4 = 0 THEN '' WHEN seq % 4 = 2 THEN NULL WHEN seq % 5 <> 0 THEN 'old' END AS note FROM runs"""


def cascade(spark, sf_dir):
    m, o = collection(spark, sf_dir, "materials"), collection(spark, sf_dir, "objects")
    r, j = collection(spark, sf_dir, "runs"), collection(spark, sf_dir, "jobs")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("t"), "user_id").alias("task_id"))
    return store.cascade_summary(m.where("subject = 'BUILDING'"), m, r, j, e, o)


def products(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('material:', p_partkey) WHEN 1 THEN concat('upload ', p_partkey) END").alias("source"), F.expr("IF(p_partkey % 4 = 0, array(CAST(p_partkey * 2 AS STRING), 'x'), array())").alias("lineage")).withColumnRenamed("p_partkey", "id")


def ui_cascade(which):
    def run(spark, sf_dir):
        ids = collection(spark, sf_dir, "materials").where("subject = 'BUILDING'")
        r = collection(spark, sf_dir, "runs").withColumn("material_id", F.when(F.col("seq") % 7 == 0, "none").otherwise(F.col("material_id")))
        return store.ui_cascade(ids, r, products(spark, sf_dir))[which].select("id")

    return run


def migration(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id")).where("CAST(id AS INT) <= 450")
    files = collection(spark, sf_dir, "results")
    entries = files.where("inside").select("id", F.col("file").alias("entry"))
    return catalog.migration(owners, files.where("stored"), entries)


def migration_details(spark, sf_dir):
    """All owners; the archives also hold a folder each."""
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    files = collection(spark, sf_dir, "results")
    entries = files.where("inside").select("id", F.col("file").alias("entry")).unionByName(files.where("file = 'full.md'").select("id", F.lit("images/").alias("entry")))
    got = catalog.migration_details(owners, files.where("stored"), entries)
    return got.withColumn("samples", F.array_join("samples", ",")).withColumn("reasons", F.array_join("reasons", ";"))


_MIGRATION = """w AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey <= 450), f AS (SELECT *, file NOT IN ('mineru-result.zip', 'full.md', 'artifact-manifest.json') AS e FROM results WHERE stored),
  g AS (SELECT id, bool_or(file = 'mineru-result.zip') AS z, bool_or(file = 'full.md') AS main, count(*) FILTER (e) AS n, coalesce(sum(size) FILTER (e), 0) AS b, count(*) FILTER (e AND NOT inside) AS lost FROM f GROUP BY id),
  s AS (SELECT id, string_agg(file, ',' ORDER BY file) AS samples FROM (SELECT * FROM f WHERE e QUALIFY row_number() OVER (PARTITION BY id ORDER BY file) <= 5) GROUP BY id),
  k AS (SELECT w.id, CASE WHEN z IS NULL THEN 'missing-artifacts' WHEN NOT z THEN 'expanded-only' WHEN n = 0 THEN 'zip-source' ELSE 'legacy-mixed' END AS kind, coalesce(main, false) AS has_main, coalesce(n, 0) AS expanded, b, samples AS names, lost FROM w LEFT JOIN g USING (id) LEFT JOIN s USING (id)),
  r AS (SELECT id, kind, has_main, expanded, CASE WHEN kind = 'legacy-mixed' THEN expanded ELSE 0 END AS removable, CAST(CASE WHEN kind = 'legacy-mixed' THEN b ELSE 0 END AS BIGINT) AS removable_bytes,
    CASE WHEN kind = 'legacy-mixed' THEN names ELSE '' END AS samples, CASE WHEN kind = 'legacy-mixed' THEN lost ELSE 0 END AS not_in_archive, kind = 'legacy-mixed' AND lost = 0 AS safe FROM k)"""


def diagnoses(runs):
    got = tasks.diagnosis(F.col("seq") % 11 != 0, F.col("seq") % 4, F.col("stage") == "mineru-processing", F.when(F.col("seq") % 3 == 0, F.col("id")), F.col("state"))
    return runs.select("id", *_fields(got))


def routes(runs):
    got = tasks.failure(F.expr(_ERROR))
    return runs.select("id", *_fields(got))


def adjudications(startup):
    return lambda runs: runs.select("id", *_fields(tasks.adjudicated(F.expr(_RAW), startup)))


def _adjudicated(startup):
    return with_collections(
        "runs",
        f"""WITH r AS (SELECT id, {_RAW} AS raw FROM runs), s AS (SELECT id, raw, raw IN ('queued', 'pending', 'running') AS w FROM r)
        SELECT id, CASE WHEN raw IS NULL THEN NULL WHEN w THEN 'running' WHEN raw = 'Done' THEN '{"result-store" if startup else "running"}' WHEN raw = 'strange' THEN {"'failed'" if startup else "NULL"} ELSE 'failed' END AS task_state,
          CASE WHEN raw IN ('queued', 'pending') THEN 'mineru-queued' WHEN raw = 'running' THEN 'mineru-processing' WHEN raw = 'Done' THEN '{"store" if startup else "result-fetching"}' WHEN raw IN ('error', 'cancelled') THEN 'mineru-failed' END AS task_stage,
          CASE WHEN raw = 'Done' THEN 'completed' WHEN raw IN ('error', 'cancelled') THEN 'failed' WHEN raw = 'not_found' THEN raw {"WHEN raw = 'strange' THEN raw WHEN raw = 'running' THEN 'processing' WHEN w THEN 'queued'" if startup else "WHEN w THEN raw"} END AS external,
          CASE WHEN raw IN ('error', 'cancelled') THEN 'failed' {"" if startup else "WHEN w OR raw = 'Done' THEN 'processing'"} END AS material_status,
          CASE WHEN raw IN ('error', 'cancelled') THEN 'failed' {"" if startup else "WHEN raw = 'Done' THEN 'completed' WHEN raw = 'running' THEN 'processing' WHEN w THEN 'queued'"} END AS material_parse, CASE WHEN raw IN ('error', 'cancelled') THEN 'pending' END AS material_ai FROM s""",
    )


def papers(spark, sf_dir):
    return collection(spark, sf_dir, "papers", "o_orderkey")


def evidence(spark, sf_dir):
    p = papers(spark, sf_dir).select("id", semistructured.evidence_of(F.get_json_object("body", "$.evidence")).alias("e"))
    return p.select("id", F.size("e").alias("n"), F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["type"], x["quote"], F.size(x["supports"]).cast("string"))), ";").alias("evidence"))


def flat(spark, sf_dir):
    return semistructured.flat_rows(papers(spark, sf_dir), "id", "body").withColumn("tags", F.array_join("tags", ","))


def unfaceted(spark, sf_dir):
    got = semistructured.flat_rows(collection(spark, sf_dir, "payloads", "o_orderkey"), "id", "result")
    return got.select("id", "title", F.array_join("tags", ",").alias("tags"), "confidence")


def facts(spark, sf_dir):
    m = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS id", "IF(c_custkey % 2 = 0, c_name, '') AS title", """IF(c_custkey % 3 = 0, concat('{"fileSize":', c_custkey, ',"objectName":"o', c_custkey, '"}'), '{"fileSize":0}') AS metadata""")
    t = collection(spark, sf_dir, "runs").select("id", "metadata", F.when(F.col("seq") % 2 == 0, F.col("message")).alias("original_filename"))
    j = collection(spark, sf_dir, "runs").where("seq % 3 = 0").select(F.concat(F.lit("j"), "id").alias("id"), F.when(F.col("seq") % 12 == 0, "gone").otherwise(F.col("id")).alias("parse_task_id"), "material_id", F.lit("in.md").alias("input_markdown_object_name"))
    return semistructured.source_facts(j, m, t).drop("execution_profile", "mime_type", "parsed_prefix")


def skeletons(spark, sf_dir):
    r = collection(spark, sf_dir, "runs", "o_orderkey")
    level = F.expr("IF(seq % 3 = 0, 'medium', 'low')")
    whole = F.to_json(semistructured.skeleton(F.expr("CASE seq % 4 WHEN 0 THEN 'json_parse_failed' WHEN 1 THEN 'Repair error' WHEN 2 THEN '' END"), F.get_json_object("metadata", "$.parsedFilesCount").cast("int"), level, {"material_id": F.col("material_id"), "file_name": F.col("message")}))
    parts = ("source", "primary_facets", "governance", "governance_signals", "catalog_change_type", "evidence")
    s = r.select("id", F.json_tuple(whole, *parts).alias(*parts))  # the text is made and read once
    return s.select(
        "id", *(F.get_json_object(c, f"$.{p}").alias(n) for n, c, p in (("material", "source", "material_id"), ("domain", "primary_facets", "domain"), ("confidence", "governance", "confidence"), ("flags", "governance", "risk_flags"), ("risk", "governance_signals", "risk"), ("quality", "governance_signals", "quality"))),
        F.col("catalog_change_type").alias("change"), F.coalesce(F.json_array_length("evidence"), F.lit(0)).alias("n_evidence"),
    )


def artifacts(spark, sf_dir):
    return semistructured.artifacts_of(papers(spark, sf_dir), "id", "body")


def historic(runs):
    payload = F.expr("""CASE seq % 4 WHEN 0 THEN concat('{"state":"', state, '","mineruTaskId":"","metadata":', metadata, '}') WHEN 1 THEN concat('{"message":"', repeat('x', 9000), '"}') WHEN 2 THEN '{"parsedArtifacts":[],"stage":"s"}' ELSE concat('{"stage":"', stage, '"}') END""")
    got = events.slim_historic(payload)
    return runs.select("id", got["slimmed"].alias("slimmed"), *(F.get_json_object(got["payload"], f"$.{k}").alias(k) for k in ("state", "stage", "mineruTaskId")), F.length(F.get_json_object(got["payload"], "$.message")).alias("message_chars"))


_NAMES = "domain collection curriculum stage level subject resource_type component_role".split()

QUERIES = {
    "f7_operational_sets": (_of("runs", lambda r: tasks.operational_sets(r).select("id", "running_external", "drifting", "not_ingested", "retryable", "takeover", "queued", "current")), with_collections("runs", f"WITH {_SETS} SELECT id, running_external, drifting, not_ingested, retryable, takeover, running_external AND stage = 'mineru-queued' AS queued, running_external AND stage = 'mineru-processing' AS current FROM s")),
    "f7_waiting_tasks": (_of("runs", lambda r: tasks.waiting_tasks(r).select("id", "created_at")), with_collections("runs", f"WITH {_SETS} SELECT id, created_at FROM s WHERE running_external AND stage = 'mineru-queued' ORDER BY created_at, id")),
    "f7_active_task": (_of("runs", lambda r: tasks.active_task(r.where("seq < 40"))), with_collections("runs", f"WITH {_SETS}, n AS (SELECT count(*) FILTER (running_external) AS running, count(*) FILTER (drifting) AS drift, max(id) FILTER (running_external) AS a, max(id) FILTER (drifting) AS b FROM s WHERE seq < 40) SELECT running, drift, CASE WHEN running = 1 THEN a WHEN running = 0 AND drift = 1 THEN b END AS active FROM n")),
    "f8_diagnostic_sets": (
        _of("runs", lambda r: tasks.diagnostic_sets(r).select("id", "active", "queued", "processing", "not_ingested", "retryable", "takeover")),
        with_collections(
            "runs",
            f"""SELECT id, state IN ('pending', 'running', 'result-store', 'ai-pending', 'ai-running') AS active, stage = 'mineru-queued' AS queued, stage = 'mineru-processing' AS processing,
            state = 'failed' AND {_EXTERNAL} AND coalesce({_j("mineruStatus")}, '') = 'completed' AND {_UNCOUNTED} AS not_ingested, state IN ('failed', 'pending') AND NOT {_EXTERNAL} AND {_RETRY} AS retryable,
            state = 'failed' AND {_EXTERNAL} AND coalesce({_j("mineruStatus")}, '') NOT IN ('failed', 'completed', 'not_found', 'artifact-empty') AS takeover FROM runs""",
        ),
    ),
    "f9_live_tasks": (_of("tasks", lambda t: tasks.live_tasks(t).select("id", "state")), with_collections("tasks", "SELECT id, state FROM tasks WHERE state IN ('pending', 'running', 'ai-pending', 'ai-running')")),
    "f17_key_allow_lists": (
        lambda s, d: table(s, d, "part").selectExpr("p_partkey", "CASE p_partkey % 7 WHEN 0 THEN 'aiConfig' WHEN 1 THEN 'aiKeys' WHEN 2 THEN concat('aiProvider_', p_partkey, '_apiKey') WHEN 3 THEN 'initialized' WHEN 4 THEN 'aiProvider_apiKey' WHEN 5 THEN concat('x', p_partkey) END AS key").select("p_partkey", catalog.setting_allowed(F.col("key")).alias("setting"), catalog.secret_allowed(F.col("key")).alias("secret")),
        "SELECT p_partkey, p_partkey % 7 IN (0, 3) AS setting, p_partkey % 7 IN (1, 2) AS secret FROM part",
    ),
    "f19_f20_persistable": (
        _of("drafts", lambda m: catalog.persistable(m).select("id", *(F.get_json_object(catalog.suppressed(F.col("metadata")), f"$.{k}").alias(k) for k in ("fileUrl", "markdownUrl", "objectName")), catalog.lasting_preview(F.col("preview")).alias("preview"), F.get_json_object(catalog.suppressed(F.col("metadata"), asset=True), "$.previewUrl").alias("asset_preview"))),
        with_collections(
            "drafts",
            f"""SELECT id, CASE WHEN coalesce({_j("provider")}, '') = 'minio' AND coalesce({_j("objectName")}, '') <> '' THEN NULL ELSE {_j("fileUrl")} END AS "fileUrl", CASE WHEN coalesce({_j("markdownObjectName")}, '') = '' THEN {_j("markdownUrl")} END AS "markdownUrl",
            {_j("objectName")} AS "objectName", CASE WHEN starts_with(preview, 'blob:') THEN '' ELSE preview END AS preview, CASE WHEN NOT starts_with({_j("previewUrl")}, 'blob:') THEN {_j("previewUrl")} END AS asset_preview
            FROM drafts WHERE coalesce({_j("localDraft")}, '') <> 'true' AND NOT (coalesce(status, '') = 'processing' AND trim(coalesce({_j("objectName")}, '')) = '')""",
        ),
    ),
    "m2_json_patch": (lambda s, d: _patched(s, d, False), _patch_sql(False)),
    "m4_json_merge_put": (lambda s, d: _patched(s, d, True), _patch_sql(True)),
    "m2_json_patches_in_order": (lambda s, d: _patches_in_order(s, d, False), _in_order_sql(False)),
    "m4_json_puts_in_order": (lambda s, d: _patches_in_order(s, d, True), _in_order_sql(True)),
    "m2_unreadable_changes": (
        lambda s, d: store.unreadable(collection(s, d, "runs").select("id", F.expr("IF(seq % 13 = 0, left(metadata, 9), metadata)").alias("metadata")), collection(s, d, "patches")),
        with_collections("runs patches", "SELECT id, 'body' AS what, body AS text FROM patches WHERE NOT json_valid(body) OR json_type(body) <> 'OBJECT' UNION ALL SELECT id, 'metadata', left(metadata, 9) FROM runs WHERE seq % 13 = 0 AND id IN (SELECT id FROM patches)"),
    ),
    "m5_protected_profile": (_of("runs", profiles), with_collections("runs", _PROFILES)),
    "m8_cascade_summary": (
        cascade,
        with_collections(
            "materials runs jobs objects",
            """WITH own AS (SELECT id, object_name FROM materials WHERE subject = 'BUILDING'), t AS (SELECT * FROM runs WHERE material_id IN (SELECT id FROM own)), n AS (SELECT count(*) AS n FROM t WHERE state IN ('running', 'mineru-processing', 'ai-running'))
            SELECT (SELECT count(*) FROM own) AS materials, (SELECT count(*) FROM own) AS asset_details, (SELECT count(*) FROM t) AS tasks, (SELECT count(*) FROM jobs WHERE parse_task_id IN (SELECT id FROM t)) AS jobs,
            (SELECT count(*) FROM events WHERE 't' || user_id IN (SELECT id FROM t)) AS events, (SELECT count(*) FROM own WHERE object_name <> '') + (SELECT count(*) FROM objects JOIN own ON starts_with(name, 'originals/' || own.id || '/') WHERE bucket = 'raw') AS original_objects,
            (SELECT count(*) FROM objects JOIN own ON starts_with(name, 'parsed/' || own.id || '/') WHERE bucket = 'parsed') AS parsed_objects, (SELECT n FROM n) AS running_tasks, (SELECT n > 0 FROM n) AS blocked""",
        ),
    ),
    "m9_ui_cascade_tasks": (ui_cascade(0), with_collections("materials runs", "SELECT id FROM runs WHERE seq % 7 = 0 OR material_id NOT IN (SELECT id FROM materials WHERE subject = 'BUILDING')")),
    "m9_ui_cascade_products": (
        ui_cascade(1),
        with_collections("materials", "WITH g AS (SELECT CAST(id AS BIGINT) AS id FROM materials WHERE subject = 'BUILDING') SELECT p_partkey AS id FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey IN (SELECT id FROM g)) AND NOT (p_partkey % 4 = 0 AND p_partkey * 2 IN (SELECT id FROM g))"),
    ),
    "m11_union_tags": (
        _of("materials", lambda m: m.select("id", F.array_join(store.with_tags(F.filter(F.split("tags", ","), lambda t: t != ""), ("n3", "extra", "n3")), ",").alias("tags"))),
        with_collections("materials", "WITH t AS (SELECT id, list_filter(string_split(tags, ','), lambda x: x <> '') AS t FROM materials) SELECT id, array_to_string(t || list_filter(['n3', 'extra'], lambda x: NOT list_contains(t, x)), ',') AS tags FROM t"),
    ),
    "m12_new_run": (
        _of("runs", lambda r: r.select("id", store.new_run(F.col("metadata"), F.to_json(F.struct(F.lit("new").alias("mineruStatus"), F.col("seq").alias("run")))).alias("metadata"))),
        with_collections("runs", f"""SELECT id, '{{' || CASE WHEN {_j("canceledAt")} IS NOT NULL THEN '"canceledAt":"2026-01-01",' ELSE '' END || '"keep":"' || {_j("keep")} || '","mineruStatus":"new","run":' || seq || '}}' AS metadata FROM runs"""),
    ),
    "m14_recovered_errors": (
        _of("runs", lambda r: store.recovered(r).select("id", "error_message", F.get_json_object("metadata", "$.previousErrorMessage").alias("previous"), F.get_json_object("metadata", "$.keep").alias("keep"))),
        with_collections(
            "runs",
            f"""WITH h AS (SELECT *, state IN ('completed', 'review-pending', 'ai-pending', 'running') AND coalesce({_j("recoveredFromMisjudgedFailed")}, '') = 'true' AND trim(coalesce(error_message, '')) <> '' AS h, {_j("previousErrorMessage")} AS p FROM runs)
            SELECT id, CASE WHEN h THEN '' ELSE error_message END AS error_message, CASE WHEN h AND trim(coalesce(p, '')) = '' THEN error_message ELSE p END AS previous, {_j("keep")} AS keep FROM h""",
        ),
    ),
    "a1_statistics": (lambda s, d: catalog.statistics(collection(s, d, "materials"), "size_bytes", {"tasks": collection(s, d, "tasks"), "jobs": collection(s, d, "jobs"), "events": table(s, d, "events")}), with_collections("materials tasks jobs", "SELECT (SELECT CAST(coalesce(sum(coalesce(size_bytes, 0)), 0) AS BIGINT) FROM materials) AS bytes, (SELECT count(*) FROM tasks) AS tasks, (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM events) AS events")),
    "a5_workspace_counts": (
        _of("runs", lambda r: catalog.workspace_counts(r.select(status.bucket(F.col("state"), F.col("stage")).alias("bucket")))),
        with_collections("runs", "WITH k AS (SELECT CASE WHEN state IN ('failed', 'canceled') THEN 'failed' WHEN state = 'completed' THEN 'completed' WHEN state = 'pending' OR (state = 'running' AND stage = 'mineru-queued') THEN 'pending' ELSE 'processing' END AS k FROM runs) SELECT count(*) AS total, count(*) FILTER (k = 'pending') AS n_pending, count(*) FILTER (k = 'processing') AS n_processing, count(*) FILTER (k = 'failed') AS n_failed, count(*) FILTER (k = 'completed') AS n_completed FROM k"),
    ),
    "a9_migration_estimate": (migration, with_collections("results", f"WITH {_MIGRATION} SELECT * FROM r")),
    "a9_migration_details": (
        migration_details,
        with_collections(
            "results",
            """WITH w AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer), f AS (SELECT *, stored AND file NOT IN ('mineru-result.zip', 'full.md', 'artifact-manifest.json') AS e FROM results),
            g AS (SELECT id, bool_or(stored) AS there, bool_or(stored AND file = 'mineru-result.zip') AS z, bool_or(stored AND file = 'full.md') AS main, count(*) FILTER (e) AS n, count(*) FILTER (inside) AS i, coalesce(sum(size) FILTER (e), 0) AS b, count(*) FILTER (e AND NOT inside) AS lost,
              array_to_string(list(file ORDER BY file) FILTER (e AND NOT inside)[1:3], ', ') AS missing, list_transform(list(file ORDER BY file) FILTER (e)[1:5], lambda x: 'parsed/' || id || '/' || x) AS names FROM f GROUP BY id),
            k AS (SELECT w.id AS id, CASE WHEN NOT coalesce(there, false) THEN 'missing-artifacts' WHEN NOT z THEN 'expanded-only' WHEN n = 0 THEN 'zip-source' ELSE 'legacy-mixed' END AS kind, * EXCLUDE (id) FROM w LEFT JOIN g USING (id))
            SELECT id, kind, coalesce(z, false) AS has_archive, coalesce(main, false) AS has_main, CASE WHEN kind = 'missing-artifacts' THEN 0 ELSE n END AS expanded, CASE WHEN kind = 'legacy-mixed' THEN i ELSE 0 END AS archive_entries, kind = 'legacy-mixed' AS main_repeats_archive,
              CASE WHEN kind = 'legacy-mixed' THEN n ELSE 0 END AS removable, CASE WHEN kind = 'legacy-mixed' THEN array_to_string(names, ',') ELSE '' END AS samples, CAST(CASE WHEN kind = 'legacy-mixed' THEN b ELSE 0 END AS BIGINT) AS removable_bytes, kind = 'legacy-mixed' AND lost = 0 AS safe,
              CASE WHEN kind = 'missing-artifacts' THEN 'No parsed artifacts found' WHEN kind = 'expanded-only' THEN 'No mineru-result.zip found' WHEN kind = 'legacy-mixed' AND lost > 0 THEN 'Found ' || lost || ' expanded objects missing in zip (e.g. ' || missing || ')' ELSE '' END AS reasons FROM k""",
        ),
    ),
    "a9_migration_summary": (
        lambda s, d: catalog.migration_summary(migration(s, d)),
        with_collections("results", f"WITH {_MIGRATION} SELECT count(*) AS scanned, count(*) FILTER (kind = 'legacy-mixed') AS legacy_mixed, count(*) FILTER (kind = 'zip-source') AS zip_source, count(*) FILTER (kind = 'expanded-only') AS expanded_only, CAST(coalesce(sum(removable) FILTER (safe), 0) AS BIGINT) AS removable, CAST(coalesce(sum(removable_bytes) FILTER (safe), 0) AS BIGINT) AS removable_bytes FROM r"),
    ),
    "j10_related_events": (
        lambda s, d: store.related(collection(s, d, "materials").where("subject = 'BUILDING'"), collection(s, d, "runs"), collection(s, d, "jobs"), table(s, d, "events").select("event_id", F.concat(F.lit("t"), "user_id").alias("task_id")))["events"].select("event_id"),
        with_collections("materials runs", "SELECT event_id FROM events WHERE 't' || user_id IN (SELECT id FROM runs WHERE material_id IN (SELECT id FROM materials WHERE subject = 'BUILDING'))"),
    ),
    "j11_archive_differences": (
        lambda s, d: catalog.unpacked_check(collection(s, d, "results").where("inside").select("id", "file"), collection(s, d, "results").where("stored").select("id", "file")),
        with_collections("results", "SELECT id, count(*) FILTER (stored AND NOT inside) AS only_objects, count(*) FILTER (inside AND NOT stored) AS only_entries, count(*) FILTER (stored AND NOT inside) = 0 AS safe FROM results WHERE stored OR inside GROUP BY id"),
    ),
    "s8_object_page": (lambda s, d: catalog.list_page(collection(s, d, "results").where("stored"), "parsed/", "parsed/2", 500).select("name", "size"), with_collections("results", "SELECT name, size FROM results WHERE stored AND starts_with(name, 'parsed/') AND name > 'parsed/2' ORDER BY name LIMIT 500")),
    "b9_diagnosis": (
        _of("runs", diagnoses),
        with_collections(
            "runs",
            """WITH f AS (SELECT *, seq % 11 <> 0 AS r, seq % 4 AS n, stage = 'mineru-processing' AS own, seq % 3 = 0 AS f, state IN ('failed', 'canceled') AS e FROM runs)
            SELECT id, CASE WHEN NOT r THEN 'unreachable' WHEN n = 0 THEN 'healthy' WHEN own OR (f AND NOT e) THEN 'busy' ELSE 'blocked' END AS status,
              CASE WHEN NOT r THEN 'unknown' WHEN n = 0 THEN 'idle' WHEN own THEN 'known-task-processing' WHEN f AND e THEN 'known-failed-but-mineru-processing' WHEN f THEN 'known-task-processing' ELSE 'orphan-processing-blocker' END AS kind FROM f""",
        ),
    ),
    "b10_failure_routes": (_of("runs", routes), with_collections("runs", "SELECT id, CASE WHEN seq % 7 IN (0, 2) THEN 'hybrid-vlm-runtime-failure' WHEN seq % 7 = 1 THEN 'hybrid-mps-runtime-failure' END AS category, CASE WHEN seq % 7 < 3 THEN 'hybrid-auto-engine' END AS engine, seq % 7 < 3 AS fallback FROM runs")),
    "b12_adjudication": (_of("runs", adjudications(False)), _adjudicated(False)),
    "b12_adjudication_at_startup": (_of("runs", adjudications(True)), _adjudicated(True)),
    "d2_overdue": (lambda s, d: table(s, d, "orders").select("o_orderkey", tasks.overdue(F.col("o_orderdate"), F.lit("1997-06-01").cast("timestamp"), F.col("o_orderkey") % 1000).alias("overdue")), "SELECT o_orderkey, epoch(TIMESTAMP '1997-06-01') - epoch(o_orderdate) > o_orderkey % 1000 + 60 AS overdue FROM orders"),
    "d4_bytes_text": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", text.bytes_text(F.expr("o_orderkey * 7919 % 4000000007")).alias("size")),
        """WITH k AS (SELECT o_orderkey, o_orderkey * 7919 % 4000000007 AS k FROM orders) SELECT o_orderkey, CASE WHEN k <= 0 THEN '0 B' WHEN k < 1024 THEN k || ' B' WHEN k < 1048576 THEN printf('%.1f', round(k / 1024.0::DOUBLE, 1)) || ' KB'
        WHEN k < 1073741824 THEN printf('%.1f', round(k / 1048576.0::DOUBLE, 1)) || ' MB' ELSE printf('%.1f', round(k / 1073741824.0::DOUBLE, 1)) || ' GB' END AS size FROM k""",
    ),
    "n3_evidence_json": (
        evidence,
        with_collections(
            "papers",
            """WITH e AS (SELECT id, unnest(from_json(json_extract(body, '$.evidence'), '["JSON"]')) AS e, generate_subscripts(from_json(json_extract(body, '$.evidence'), '["JSON"]'), 1) AS i FROM papers),
            t AS (SELECT id, i, CASE WHEN json_type(e) = 'VARCHAR' THEN trim(e ->> '$') ELSE trim(coalesce(e ->> '$.quote_or_summary', '')) END AS q, CASE WHEN (e ->> '$.type') IN ('filename', 'title_page', 'toc', 'body', 'system', 'unknown') THEN e ->> '$.type' ELSE 'unknown' END AS t,
              coalesce(json_array_length(e, '$.supports'), 0) AS s FROM e WHERE json_type(e) IN ('VARCHAR', 'OBJECT')), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM t WHERE q <> '')
            SELECT p.id, CAST(count(k.n) AS INT) AS n, coalesce(string_agg(t || ':' || q || ':' || s, ';' ORDER BY n), '') AS evidence FROM papers p LEFT JOIN k ON k.id = p.id AND k.n <= 20 GROUP BY p.id""",
        ),
    ),
    "n5_whole_skeleton": (
        skeletons,
        with_collections(
            "runs",
            f"""WITH f AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'medium' ELSE 'low' END AS c, CASE WHEN seq % 3 <> 0 AND seq % 4 IN (0, 1) THEN '"skeleton_fallback","ai_provider_json_' || CASE seq % 4 WHEN 0 THEN 'parse' ELSE 'repair' END || '_failed"' ELSE '' END AS flags FROM runs)
            SELECT id, material_id AS material, '{{"zh":"","en":""}}' AS domain, c AS confidence, '[' || flags || ']' AS flags,
              '[' || CASE WHEN flags <> '' THEN flags || ',"skeleton_fallback",' ELSE '' END || CASE WHEN c = 'low' THEN '"low_confidence",' ELSE '' END || '"needs_human_review"' || CASE WHEN flags = '' THEN ',"evidence_missing"' ELSE '' END || ']' AS risk,
              CASE WHEN {_UNCOUNTED} THEN '["no_parsed_artifacts"]' ELSE '[]' END AS quality, 'needs_human_review' AS change, CASE WHEN flags <> '' THEN 1 ELSE 0 END AS n_evidence FROM f""",
        ),
    ),
    "n7_flattened_result": (
        flat,
        with_collections(
            "papers",
            """WITH z AS (SELECT id, body, """ + ", ".join(f"coalesce(nullif(body ->> '$.controlled_classification.{f}.zh', ''), body ->> '$.primary_facets.{f}.zh', '') AS {f}" for f in ("subject", "stage", "level", "resource_type", "component_role", "curriculum")) + """, coalesce(body ->> '$.governance.confidence', '') AS g, coalesce(body ->> '$.descriptive_metadata.series_title', '') AS t FROM papers),
            s AS (SELECT *, array_to_string(list_filter([subject, stage, level, resource_type], lambda x: x <> ''), ' · ') AS summary FROM z)
            SELECT id, coalesce(nullif(t, ''), nullif(summary, ''), subject) AS title, subject, coalesce(nullif(level, ''), stage) AS grade, coalesce(nullif(resource_type, ''), component_role) AS material_type, coalesce(nullif(body ->> '$.descriptive_metadata.language', ''), '中文') AS language, curriculum,
              array_to_string(list_transform(coalesce(from_json(json_extract(body, '$.normalized_tags.topic_tags'), '["JSON"]'), []) || coalesce(from_json(json_extract(body, '$.system_tags.format_tags'), '["JSON"]'), []), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' ELSE coalesce(nullif(x ->> '$.zh', ''), x ->> '$.en') END), ',') AS tags,
              summary, CASE g WHEN 'high' THEN 90 WHEN 'medium' THEN 60 ELSE 30 END AS confidence, coalesce(body ->> '$.governance.human_review_required', '') = 'true' OR g <> 'high' AS needs_review FROM s""",
        ),
    ),
    "n8_source_facts": (
        facts,
        with_collections(
            "runs",
            f"""WITH j AS (SELECT *, seq % 12 <> 0 AS has FROM runs WHERE seq % 3 = 0), r AS (SELECT j.*, c_custkey, c_name FROM j LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = material_id)
            SELECT 'j' || id AS job_id, material_id, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN has AND seq % 2 = 0 THEN message ELSE 'unknown' END AS filename, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE 0 END AS file_size,
              CASE WHEN c_custkey % 3 = 0 THEN 'o' || c_custkey ELSE '' END AS raw_object_name, 'in.md' AS markdown_object_name, CASE WHEN has THEN CAST(coalesce({_j("parsedFilesCount")}, '0') AS BIGINT) ELSE 0 END AS parsed_files_count FROM r""",
        ),
    ),
    "n9_markdown_paths": (
        lambda s, d: papers(s, d).select("id", semistructured.markdown_of(F.col("parsed")).alias("markdown")),
        with_collections("papers", "SELECT id, CASE WHEN k % 17 = 4 THEN '' ELSE 'text ' || k END AS markdown FROM papers"),
    ),
    "n9_first_results": (
        lambda s, d: collection(s, d, "payloads").select("id", semistructured.markdown_of(F.col("parsed")).alias("markdown")),
        with_collections(
            "payloads",
            """WITH k AS (SELECT id, parsed, json_type(parsed, '$.results') AS kind, CASE json_type(parsed, '$.results') WHEN 'OBJECT' THEN json_keys(parsed, '$.results') ELSE [] END AS keys FROM payloads),
            n AS (SELECT *, coalesce(CAST(list_min(list_transform(list_filter(keys, lambda x: regexp_matches(x, '^(0|[1-9][0-9]*)$')), lambda x: CAST(x AS BIGINT))) AS VARCHAR), keys[1]) AS key FROM k),
            r AS (SELECT *, CASE kind WHEN 'ARRAY' THEN json_extract(parsed, '$.results[0]') ELSE json_extract(parsed, '$.results."' || key || '"') END AS r FROM n),
            m AS (SELECT *, CASE WHEN coalesce(json_type(r, '$.md_content'), 'NULL') <> 'NULL' THEN json_extract(r, '$.md_content') WHEN coalesce(json_type(r, '$.mdcontent'), 'NULL') <> 'NULL' THEN json_extract(r, '$.mdcontent') ELSE json_extract(r, '$.mdContent') END AS md FROM r),
            c AS (SELECT id, CASE WHEN json_type(md) = 'VARCHAR' THEN md ->> '$' END AS first, parsed FROM m),
            p AS (SELECT id, first, list_transform(['$.md_content', '$.mdcontent', '$.mdContent', '$.md_text', '$.markdown', '$.text', '$.data.md_content', '$.data.mdcontent', '$.data.mdContent', '$.data.md_text', '$.data.markdown', '$.data.text', '$.output.md_text', '$.output.markdown'],
              lambda x: CASE WHEN json_type(json_extract(parsed, x)) = 'VARCHAR' THEN json_extract_string(parsed, x) END) AS found, CASE WHEN json_type(parsed, '$.data') = 'ARRAY' THEN list_filter(from_json(json_extract(parsed, '$.data'), '["JSON"]'), lambda x: json_type(x) = 'VARCHAR')[1] ->> '$' END AS listed FROM c)
            SELECT id, coalesce(nullif(trim(first), ''), list_filter(list_transform(found, lambda x: trim(x)), lambda x: x <> '')[1], nullif(trim(listed), ''), '') AS markdown FROM p""",
        ),
    ),
    "n7_results_without_facets": (
        unfaceted,
        with_collections(
            "payloads",
            """SELECT id, CASE WHEN k THEN coalesce(result ->> '$.primary_facets.subject.zh', '') ELSE '解析失败' END AS title, CASE WHEN k THEN array_to_string(list_transform(from_json(json_extract(result, '$.normalized_tags.topic_tags'), '["JSON"]'), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN coalesce(nullif(x ->> '$.zh', ''), x ->> '$.en') ELSE x ->> '$' END)
              || list_transform(from_json(json_extract(result, '$.system_tags.format_tags'), '["JSON"]'), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN coalesce(x ->> '$.zh', x ->> '$.en') ELSE x ->> '$' END), ',') END AS tags, CASE WHEN k THEN 90 END AS confidence
            FROM (SELECT id, result, coalesce(json_type(result, '$.primary_facets') = 'OBJECT', false) AS k FROM payloads)""",
        ),
    ),
    "f7_current_task": (_of("runs", lambda r: tasks.current_task(r).select("id", "seq")), with_collections("runs", f"WITH {_SETS} SELECT id, seq FROM s WHERE running_external AND stage = 'mineru-processing' ORDER BY seq LIMIT 1")),
    "f7_whole_active_task": (_of("runs", tasks.active_task), with_collections("runs", f"WITH {_SETS}, n AS (SELECT count(*) FILTER (running_external) AS running, count(*) FILTER (drifting) AS drift, max(id) FILTER (running_external) AS a, max(id) FILTER (drifting) AS b FROM s) SELECT running, drift, CASE WHEN running = 1 THEN a WHEN running = 0 AND drift = 1 THEN b END AS active FROM n")),
    "n10_slim_historic": (
        _of("runs", historic),
        with_collections(
            "runs",
            f"""SELECT id, seq % 4 <> 3 AS slimmed, CASE WHEN seq % 4 = 0 THEN state END AS state, CASE seq % 4 WHEN 2 THEN 's' WHEN 3 THEN stage END AS stage, CASE WHEN seq % 4 = 0 THEN {_j("mineruTaskId")} END AS "mineruTaskId", CAST(CASE WHEN seq % 4 = 1 THEN 500 END AS INT) AS message_chars FROM runs""",
        ),
    ),
    "n11_artifact_rows": (
        artifacts,
        with_collections(
            "papers",
            """WITH l AS (SELECT id, k, unnest([{'n': 0, 'path': 'a' || k, 'media_type': 'image/png', 'source': 'bytes', 'content': 'QQ=='}, {'n': 2, 'path': 'd' || k, 'media_type': NULL, 'source': 'url', 'content': 'HTTP://h/' || k}, {'n': 3, 'path': 'r1', 'media_type': NULL, 'source': 'bytes', 'content': 'Qg=='}, {'n': 4, 'path': 'r2', 'media_type': 'x/y', 'source': 'url', 'content': 'https://h/r'}]) AS a FROM papers WHERE k % 3 <> 0)
            SELECT id, CAST(a.n AS INT) AS nth, a.path AS path, a.media_type AS media_type, a.source AS source, a.content AS content FROM l""",
        ),
    ),
    "x1_facet_values": (
        lambda s, d: semistructured.facet_values(papers(s, d), "id", "body"),
        with_collections("papers", "WITH f AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS name, CASE WHEN json_type(body, '$.primary_facets.{f}') = 'VARCHAR' THEN nullif(body ->> '$.primary_facets.{f}', '') ELSE coalesce(nullif(body ->> '$.primary_facets.{f}.zh', ''), nullif(body ->> '$.primary_facets.{f}.en', '')) END AS value FROM papers" for f in _NAMES) + ") SELECT * FROM f WHERE trim(value) <> ''"),
    ),
}
