"""Model output, artifacts and the taxonomy (N, X and J12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.json_tree import has_dangerous_key, redacted
from quire.operators import semistructured as semi
from quire.operators import tasks, taxonomy
from quire.plans.proxies import collection, with_collections
from quire.sources import table

#: A small taxonomy: (kind, name, ordinal, id, zh, en, aliases).
ENTRIES = [
    ("facet", "subject", 1, "building", "建筑", "BUILDING", ["construction"]), ("facet", "subject", 2, "machines", "机械", "machinery", ["building", "machine"]), ("facet", "subject", 3, "home", "家居", "household", []),
    ("facet", "domain", 1, "06_公司行政经营资料", "行政", "office", ["r0"]), ("facet", "domain", 2, "01_教材", "教材", "textbook", ["r1", "r2"]), ("facet", "stage", 1, "s1", "初级", "n1", ["n2", "n3"]),
    ("tag", "topic_tags", 1, "阅读", "阅读", "reading", ["en"]), ("tag", "topic_tags", 2, "auto", "汽车", "automobile", ["cars"]),
]
_TAX = "tax(kind, name, ordinal, id, zh, en, aliases) AS (VALUES " + ", ".join(f"('{k}', '{n}', {o}, '{i}', '{z}', '{e}', [{', '.join(repr(a) for a in al)}]::VARCHAR[])" for k, n, o, i, z, e, al in ENTRIES) + ")"
_KEYS = "keys AS (SELECT * FROM (SELECT kind, name, ordinal, id, zh, unnest(list_distinct(list_concat([id], list_transform(list_concat([zh, en], aliases), lambda x: lower(x))))) AS key FROM tax) QUALIFY row_number() OVER (PARTITION BY kind, name, key ORDER BY ordinal) = 1)"
_RAW = """raw AS (SELECT id AS doc_id, 'subject' AS name, subject AS value FROM materials UNION ALL SELECT id, 'domain', CASE CAST(id AS BIGINT) % 5 WHEN 3 THEN '' WHEN 4 THEN 'nowhere' ELSE ' R' || CAST(CAST(id AS BIGINT) % 5 AS VARCHAR) END FROM materials
  UNION ALL SELECT id, 'stage', 'N' || CAST(CAST(id AS BIGINT) % 4 AS VARCHAR) FROM materials)"""


def _taxonomy(spark):
    return spark.createDataFrame(ENTRIES, "kind string, name string, ordinal int, id string, zh string, en string, aliases array<string>")


def _raw(spark, sf_dir):
    m = collection(spark, sf_dir, "materials")
    n = F.col("id").cast("bigint")
    domain = F.when(n % 5 == 3, "").when(n % 5 == 4, "nowhere").otherwise(F.concat(F.lit(" R"), (n % 5).cast("string")))
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in (("subject", F.col("subject")), ("domain", domain), ("stage", F.concat(F.lit("N"), (n % 4).cast("string"))))))
    return m.select(F.col("id").alias("doc_id"), F.inline(pairs))


def facets(spark, sf_dir):
    return taxonomy.facets(_raw(spark, sf_dir), _taxonomy(spark))


def tags(spark, sf_dir):
    m = collection(spark, sf_dir, "materials")
    raw = m.select(F.col("id").alias("doc_id"), F.lit("topic_tags").alias("name"), F.explode(F.split("tags", ",")).alias("value"))
    got = taxonomy.tags(raw, _taxonomy(spark))
    return got.withColumn("state", taxonomy.final_state(F.lit(""), F.col("proposed")))


def _output(spark, sf_dir):
    """Model output in several wrappings around one JSON object."""
    e = table(spark, sf_dir, "events").select("event_id", "props", "event_type")
    n = F.col("event_id") % 5
    wrapped = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("<think>{x}</think>\nHere: ```json\n"), "props", F.lit("\n```"))).when(n == 2, F.concat(F.lit("so "), "props", F.lit(" done"))).when(n == 3, F.lit("no object")).otherwise(F.concat(F.lit("{ broken "), "props"))
    return e.withColumn("raw", wrapped)


def extracted(spark, sf_dir):
    return _output(spark, sf_dir).select("event_id", semi.extract_json(F.col("raw")).alias("json"))


def schema(spark, sf_dir):
    n = F.col("event_id") % 4
    json = F.when(n == 0, '{"primary_facets": {}, "governance": {"a": 1}, "evidence": []}').when(n == 1, '{"primary_facets": [], "governance": {}, "evidence": []}').when(n == 2, '{"primary_facets": {}}').otherwise("x")
    return table(spark, sf_dir, "events").select("event_id", semi.has_schema(json).alias("ok"))


def evidence(spark, sf_dir):
    rows = F.array(F.struct(F.col("event_type").alias("type"), F.lit(" a ").alias("quote")), F.struct(F.lit("body").alias("type"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("q"), "event_id")).otherwise(" ").alias("quote")), F.struct(F.lit("toc").alias("type"), F.lit(None).cast("string").alias("quote")))
    got = semi.evidence(rows)
    return table(spark, sf_dir, "events").select("event_id", F.size(got).alias("n"), F.array_join(F.transform(got, lambda e: F.concat_ws("=", e["type"], e["quote"])), ";").alias("evidence"))


def system_tags(spark, sf_dir):
    t = collection(spark, sf_dir, "tasks")
    name = F.when(F.col("seq") % 2 == 0, "a.PDF").otherwise("a.md")
    backend = F.when(F.col("seq") % 3 == 0, "Pipeline").when(F.col("seq") % 3 == 1, "hybrid-auto").otherwise("vlm")
    got = semi.system_tags(name, F.when(F.col("seq") % 5 == 0, "application/pdf"), backend, F.col("seq") % 7 == 0, F.col("parsed_files_count") * 8)
    return t.select("id", F.array_join(got, ",").alias("tags"))


def review(spark, sf_dir):
    m = collection(spark, sf_dir, "materials")
    n = F.col("id").cast("bigint")
    got = semi.governance(F.when(n % 4 > 0, "d"), F.col("subject"), F.when(n % 3 == 0, "r"), F.when(n % 5 == 0, "c").otherwise(""), F.when(n % 2 == 0, "high").when(n % 7 == 0, "odd").otherwise("medium"), n % 3, F.when(n % 6 == 0, 1).otherwise(0), F.lit(None).cast("boolean"), F.when(n % 10 == 0, "mine"), n % 2)
    return m.select("id", *(F.array_join(c, ",").alias(k) if k in ("risk_flags", "risk") else c.alias(k) for k, c in got.items()))


def texts(spark, sf_dir):
    json = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" ").alias("md"), F.struct(F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("content")).alias("data")))
    return table(spark, sf_dir, "events").select("event_id", semi.first_text(json, ("$.md", "$.markdown", "$.data.content", "$.result.md")).alias("markdown"))


def _files(spark, sf_dir):
    o = collection(spark, sf_dir, "objects")
    path = F.when(F.col("owner") % 3 == 0, F.concat(F.lit("x/auto/"), F.repeat(F.lit("a"), F.col("nr")), F.lit(".md"))).when(F.col("nr") == 2, "z/full.md").otherwise(F.concat(F.lit("p/"), F.repeat(F.lit("b"), 9 - F.col("nr")), F.lit(".md")))
    return o.select("owner", F.col("nr").alias("ordinal"), path.alias("path"))


def markdown(spark, sf_dir):
    return semi.primary_markdown(_files(spark, sf_dir)).select("owner", "path")


def artifacts(spark, sf_dir):
    got = semi.distinct_artifacts(collection(spark, sf_dir, "objects"), ["bucket", "name"], "owner").groupBy("bucket").agg(F.count("*").alias("n"))
    return got


def quality(spark, sf_dir):
    names = F.array_union(F.array(F.concat("name", F.lit("_middle.json"))), F.array("name"))
    got = semi.artifact_flags(names)
    return collection(spark, sf_dir, "objects").select("owner", "nr", *(c.alias(k) for k, c in got.items()))


def flattened(spark, sf_dir):
    m = collection(spark, sf_dir, "materials")
    return m.select("id", F.concat_ws(" · ", F.nullif("subject", F.lit("")), F.nullif("ai_status", F.lit("")), F.col("status")).alias("summary"), F.coalesce(F.nullif("ai_job_id", F.lit("")), F.nullif("markdown_object_name", F.lit("")), F.col("title")).alias("fact"))


def _nested(spark, sf_dir):
    json = F.to_json(F.struct(F.struct(F.col("n_name").alias("apiKey"), F.array(F.struct(F.col("n_name").alias("Token_x"), F.col("n_name").alias("b"))).alias("list")).alias("a"), F.col("n_nationkey").alias(("id"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", json.alias("json"))


def redaction(spark, sf_dir):
    return _nested(spark, sf_dir).select("n_nationkey", redacted("json").alias("json"))


def dangerous(spark, sf_dir):
    json = F.when(F.col("n_nationkey") % 3 == 0, '{"a":{"b":[{"__proto__":1}]}}').when(F.col("n_nationkey") % 3 == 1, "not json").otherwise(F.col("json"))
    return _nested(spark, sf_dir).select("n_nationkey", has_dangerous_key(json).alias("dangerous"))


def skeletons(spark, sf_dir):
    n = F.col("n_nationkey") % 3
    got = semi.fallback(F.when(n == 0, "json_parse_failed").when(n == 1, "Repair error"), F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(got["risk_flags"], ",").alias("risk_flags"), F.array_join(got["risk"], ",").alias("risk"), got["quality"].alias("quality"))


def percent(spark, sf_dir):
    done, total = F.col("o_orderkey") % 40, F.col("o_custkey") % 4 * 16
    return table(spark, sf_dir, "orders").select("o_orderkey", tasks.percent(done, total).alias("percent"))


#: Orders as nested JSON: a sensitive key in a third of them, a dangerous one as a key or, which does not matter, as a value.
_DEEP_SQL = """SELECT o_orderkey AS id, o_orderkey AS k, '{"a":[1,{"' || CASE WHEN o_orderkey % 3 = 0 THEN 'userToken' ELSE 'user' END || '":' AS head,
  '{"x":[{"' || CASE WHEN o_orderkey % 5 = 0 THEN '__proto__' ELSE 'y' END || '":"constructor"}]}' AS inner_json, '},null],"b":{"c":{"' || CASE WHEN o_orderkey % 7 = 0 THEN 'prototype' ELSE 'type' END || '":"' || o_orderpriority || '"}}}' AS tail FROM orders"""


def _deep(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_as_json")
    return spark.sql(_DEEP_SQL.replace("FROM orders", "FROM orders_as_json")).select("id", F.concat("head", "inner_json", "tail").alias("j"))


QUERIES = {
    "f12_redaction": (
        redaction,
        """SELECT n_nationkey, '{"a":{"apiKey":"<redacted>","list":[{"Token_x":"<redacted>","b":"' || n_name || '"}]},"id":' || n_nationkey || '}' AS json FROM nation""",
    ),
    "f13_dangerous_keys": (dangerous, "SELECT n_nationkey, n_nationkey % 3 = 0 AS dangerous FROM nation"),
    "f12_whole_redaction": (lambda s, d: _deep(s, d).select("id", redacted("j").alias("json")), f"SELECT id, CASE WHEN k % 3 = 0 THEN head || '\"<redacted>\"' || tail ELSE head || inner_json || tail END AS json FROM ({_DEEP_SQL})"),
    "f13_whole_dangerous_keys": (lambda s, d: _deep(s, d).select("id", has_dangerous_key("j").alias("dangerous")), f"SELECT id, k % 5 = 0 OR k % 7 = 0 AS dangerous FROM ({_DEEP_SQL})"),
    "n5_fallback_skeleton": (
        skeletons,
        """WITH f AS (SELECT *, 'skeleton_fallback' || CASE n_nationkey % 3 WHEN 0 THEN ',ai_provider_json_parse_failed' WHEN 1 THEN ',ai_provider_json_repair_failed' ELSE '' END AS risk_flags FROM nation)
           SELECT n_nationkey, risk_flags, risk_flags || ',skeleton_fallback,low_confidence,needs_human_review' AS risk, CASE WHEN n_regionkey = 0 THEN 'no_parsed_artifacts' END AS quality FROM f""",
    ),
    "d6_progress_percent": (percent, "SELECT o_orderkey, coalesce(CAST(round(CASE WHEN o_custkey % 4 > 0 THEN (o_orderkey % 40)::DOUBLE / (o_custkey % 4 * 16) * 100 END) AS BIGINT), 0) AS percent FROM orders"),
    "n1_extract_json": (
        extracted,
        """WITH r AS (SELECT event_id, props FROM events) SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN props END AS json FROM r""",
    ),
    "n2_schema_check": (schema, "SELECT event_id, event_id % 4 = 0 AS ok FROM events"),
    "n3_evidence": (
        evidence,
        """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 2 ELSE 1 END AS n, CASE WHEN event_type IN ('filename', 'title_page', 'toc', 'body', 'system', 'unknown') THEN event_type ELSE 'unknown' END || '=a' || CASE WHEN event_id % 3 > 0 THEN ';body=q' || event_id ELSE '' END AS evidence FROM events""",
    ),
    "n4_system_tags": (
        system_tags,
        with_collections(
            "tasks",
            """SELECT id, array_to_string(list_filter([CASE WHEN seq % 2 = 0 OR seq % 5 = 0 THEN 'pdf' END, CASE WHEN seq % 7 = 0 THEN 'ocr_enabled' END, CASE WHEN parsed_files_count > 0 THEN 'has_parsed_artifacts' END, CASE WHEN parsed_files_count * 8 >= 50 THEN 'many_artifacts' END,
              CASE seq % 3 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'hybrid_auto_engine' ELSE 'vlm_auto_engine' END], lambda x: x IS NOT NULL), ',') AS tags FROM tasks""",
        ),
    ),
    "n6_governance": (
        review,
        with_collections(
            "materials",
            """WITH v AS (SELECT id, CAST(id AS BIGINT) AS n, subject FROM materials), f AS (SELECT *, n % 4 = 0 AS dm, subject = '' AS sm, n % 3 <> 0 AND n % 5 <> 0 AS rm, n % 3 = 0 AS em, n % 6 = 0 AS pn,
              CASE WHEN n % 4 = 0 THEN 'low' WHEN n % 2 = 0 THEN 'high' WHEN n % 7 = 0 THEN 'low' ELSE 'medium' END AS confidence FROM v), r AS (SELECT *, dm OR sm OR rm OR em OR pn OR confidence = 'low' AS review FROM f)
            SELECT id, confidence, concat_ws(',', CASE WHEN dm THEN 'domain_missing' END, CASE WHEN sm THEN 'subject_missing' END, CASE WHEN rm THEN 'resource_type_missing' END, CASE WHEN em THEN 'evidence_missing' END) AS risk_flags, review,
              CASE WHEN n % 10 = 0 THEN 'mine' WHEN pn THEN 'Contains proposed new tags' WHEN em THEN 'Evidence missing' WHEN review THEN 'Review required' END AS reason,
              concat_ws(',', CASE WHEN dm THEN 'domain_missing' END, CASE WHEN sm THEN 'subject_missing' END, CASE WHEN rm THEN 'resource_type_missing' END, CASE WHEN em THEN 'evidence_missing' END, CASE WHEN confidence = 'low' THEN 'low_confidence' END, CASE WHEN review THEN 'needs_human_review' END) AS risk,
              CASE WHEN n % 2 = 0 THEN 'no_parsed_artifacts' END AS quality FROM r""",
        ),
    ),
    "n7_n8_flattened": (flattened, with_collections("materials", "SELECT id, concat_ws(' · ', nullif(subject, ''), nullif(ai_status, ''), status) AS summary, coalesce(nullif(ai_job_id, ''), nullif(markdown_object_name, ''), title) AS fact FROM materials")),
    "n9_first_text": (texts, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN props END AS markdown FROM events"),
    "n11_n12_artifacts": (artifacts, with_collections("objects", "SELECT bucket, count(DISTINCT name) AS n FROM objects GROUP BY bucket")),
    "n13_primary_markdown": (
        markdown,
        with_collections(
            "objects",
            """WITH f AS (SELECT owner, nr, CASE WHEN owner % 3 = 0 THEN 'x/auto/' || repeat('a', nr) || '.md' WHEN nr = 2 THEN 'z/full.md' ELSE 'p/' || repeat('b', 9 - nr) || '.md' END AS path FROM objects)
            SELECT owner, path FROM f QUALIFY row_number() OVER (PARTITION BY owner ORDER BY path = 'z/full.md' DESC, length(path), nr) = 1""",
        ),
    ),
    "n15_artifact_flags": (quality, with_collections("objects", "SELECT owner, nr, true AS has_middle, ends_with(name, '_model.json') AS has_model, ends_with(name, '.pdf') AS has_pdf FROM objects")),
    "j12_x1_x3_facets": (
        facets,
        with_collections(
            "materials",
            f"""WITH {_TAX}, {_KEYS}, {_RAW}, f AS (SELECT r.*, k.id, k.zh FROM raw r LEFT JOIN keys k ON k.kind = 'facet' AND k.name = r.name AND k.key = lower(trim(r.value)) WHERE trim(r.value) <> ''),
            o AS (SELECT *, bool_or(name = 'domain' AND coalesce(id = '06_公司行政经营资料', false)) OVER (PARTITION BY doc_id) AS outside FROM f),
            m AS (SELECT *, id IS NOT NULL AND NOT (outside AND name IN ('subject', 'stage')) AS ok FROM o)
            SELECT doc_id, coalesce(string_agg(name || '=' || id, ';' ORDER BY name || '=' || id) FILTER (ok), '') AS controlled, coalesce(string_agg(name || '=' || coalesce(zh, value), ';' ORDER BY name || '=' || coalesce(zh, value)) FILTER (NOT ok), '') AS unmatched,
              array_to_string(list_sort(list_concat(coalesce(list('unmatched_' || name) FILTER (NOT ok), []), CASE WHEN bool_or(outside) THEN ['non_education_domain'] ELSE [] END, CASE WHEN bool_or(NOT ok AND name IN ('domain', 'subject')) THEN ['unmatched_core_facets'] ELSE [] END)), ';') AS reasons
            FROM m GROUP BY doc_id""",
        ),
    ),
    "x4_x5_tags": (
        tags,
        with_collections(
            "materials",
            f"""WITH {_TAX}, {_KEYS}, r AS (SELECT id AS doc_id, unnest(string_split(tags, ',')) AS value FROM materials), f AS (SELECT r.*, k.id FROM r LEFT JOIN keys k ON k.kind = 'tag' AND k.name = 'topic_tags' AND k.key = lower(trim(value)) WHERE trim(value) <> ''),
            t AS (SELECT doc_id, coalesce(string_agg(DISTINCT id, ';' ORDER BY id), '') AS matched, coalesce(string_agg(DISTINCT value, ';' ORDER BY value) FILTER (id IS NULL AND length(value) BETWEEN 2 AND 29), '') AS proposed FROM f GROUP BY doc_id)
            SELECT *, CASE WHEN proposed <> '' THEN 'review-pending' ELSE 'confirmed' END AS state FROM t""",
        ),
    ),
}
