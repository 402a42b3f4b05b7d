"""Stand-ins for the catalog's collections, cut from the generic tables.

Each text is SQL that Spark and DuckDB both run, so an oracle reads the same
rows as the operator. Some parents are dropped and some states are made up on
purpose, so that anti joins, drift rules and repairs have something to find.
They exercise the operators, not the reference data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources import table

SQL = {
    "materials": """
        SELECT CAST(c_custkey AS STRING) AS id, c_name AS title,
          CASE c_custkey % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'reviewing' END AS status,
          CASE c_custkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'pending' END AS mineru_status,
          CASE c_custkey % 3 WHEN 0 THEN 'analyzed' WHEN 1 THEN 'failed' ELSE '' END AS ai_status,
          CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS subject,
          CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'en,' || lower(c_mktsegment) || ',n' || CAST(c_nationkey AS STRING) END AS tags,
          CAST(floor(c_acctbal * 100) AS BIGINT) AS size_bytes, c_custkey * 1000 AS create_time,
          CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 97 END AS update_time,
          CASE WHEN c_custkey % 9 = 0 THEN 'uploads/' ELSE 'originals/' END || CAST(c_custkey AS STRING) || '/file.pdf' AS object_name,
          CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 10 = 0 THEN 'parsed/x/full.md' ELSE 'parsed/' || CAST(c_custkey AS STRING) || '/full.md' END AS markdown_object_name,
          CASE WHEN c_custkey % 4 = 1 THEN 'j' || CAST(c_custkey AS STRING) ELSE '' END AS ai_job_id,
          CASE WHEN c_custkey % 5 = 4 THEN 'n/a' WHEN c_custkey % 5 = 3 THEN NULL ELSE CAST(c_custkey % 7 AS STRING) END AS parsed_files_count
        FROM {customer} WHERE c_custkey % 7 <> 0""",
    "tasks": """
        SELECT 't' || CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS material_id, o_orderkey AS seq,
          CASE o_orderkey % 13 WHEN 0 THEN 'uploading' WHEN 1 THEN 'pending' WHEN 2 THEN 'running' WHEN 3 THEN 'result-store' WHEN 4 THEN 'ai-pending' WHEN 5 THEN 'ai-running'
            WHEN 6 THEN 'review-pending' WHEN 7 THEN 'completed' WHEN 8 THEN 'failed' WHEN 9 THEN 'canceled' WHEN 10 THEN 'success' WHEN 11 THEN 'completed' END AS state,
          CASE o_orderkey % 5 WHEN 0 THEN 'mineru-queued' WHEN 1 THEN 'mineru-processing' WHEN 2 THEN 'submit-failed-retryable' ELSE '' END AS stage,
          o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '2' HOUR END AS updated_at,
          CASE WHEN o_orderkey % 6 = 0 THEN 'm' || CAST(o_orderkey AS STRING) ELSE '' END AS mineru_task_id,
          CASE o_orderkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' ELSE '' END AS mineru_status,
          CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' ELSE '' END AS error_message, o_orderpriority AS message,
          CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate END AS canceled_at,
          CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 9 END AS parsed_files_count, o_orderkey % 8 AS retries, o_totalprice AS price
        FROM {orders}""",
    "jobs": """
        SELECT 'j' || CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 30 = 0 THEN 'gone' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 33 = 0 THEN '' ELSE 't' || CAST(o_orderkey AS STRING) END AS parse_task_id,
          CASE o_orderkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'review-pending' WHEN 4 THEN 'failed' WHEN 5 THEN 'succeeded' ELSE 'skipped-canceled' END AS state,
          o_orderkey AS seq, o_orderdate AS created_at
        FROM {orders} WHERE o_orderkey % 3 = 0""",
    "objects": """
        SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'raw' ELSE 'parsed' END AS bucket,
          CASE WHEN l_orderkey % 40 = 0 THEN 'loose' WHEN l_linenumber % 2 = 0 THEN 'originals/' || CAST(l_partkey % 400 AS STRING) || '/file.pdf'
            WHEN l_linenumber % 3 = 0 THEN 'parsed/' || CAST(l_partkey % 400 AS STRING) || '/full.md' ELSE 'parsed/' || CAST(l_partkey % 400 AS STRING) || '/images/' || CAST(l_suppkey AS STRING) || '.jpg' END AS name,
          CAST(l_quantity AS BIGINT) AS size, l_orderkey AS owner, l_linenumber AS nr
        FROM {lineitem}""",
    "log_lines": """
        SELECT o_custkey % 20 AS source, o_orderkey AS seq,
          CASE o_orderkey % 11
            WHEN 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'OCR-rec ' ELSE '' END || 'Predict: ' || CAST(o_custkey % 101 AS STRING) || '%|###| ' || CAST(o_custkey % 101 AS STRING) || '/100 [00:01<00:02]'
            WHEN 1 THEN 'Hybrid processing window ' || CAST(o_custkey % 3 + 1 AS STRING) || '/4: pages 1-' || CAST(o_custkey % 30 + 1 AS STRING) || '/' || CAST(o_custkey % 60 + 1 AS STRING)
            WHEN 2 THEN '2026-04-25 1' || CAST(o_orderkey % 10 AS STRING) || ':00:00 page_count=' || CAST(o_custkey % 90 AS STRING) || ', window_size=64'
            WHEN 3 THEN 'Using transformers for OCR detection model'
            WHEN 4 THEN '2026-04-25 0' || CAST(o_orderkey % 10 AS STRING) || ':05:00 GET /health 200 OK'
            WHEN 5 THEN '"GET /tasks/a8b51d08-a206 HTTP/1.1" 200'
            WHEN 6 THEN CASE WHEN o_custkey % 9 = 0 THEN '2026-04-25 10:10:00 ERROR: OutOfMemoryError in CUDA' ELSE 'ERROR: something odd' END
            WHEN 7 THEN '   '
            WHEN 8 THEN 'Layout Predict: ' || CAST(o_orderkey % 100 AS STRING) || '%|#| ' || CAST(o_orderkey % 50 AS STRING) || '/50 [x]'
            ELSE 'some random text ' || o_orderpriority END AS line
        FROM {orders}""",
    "runs": """
        SELECT 't' || CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS material_id, o_orderkey AS seq, CASE WHEN o_orderkey % 9 = 0 THEN 'cloud' ELSE 'local-mineru' END AS engine,
          CASE o_orderkey % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'running' WHEN 3 THEN 'failed' WHEN 4 THEN 'canceled' WHEN 5 THEN 'completed' WHEN 6 THEN 'review-pending' ELSE 'ai-running' END AS state,
          CASE o_custkey % 6 WHEN 0 THEN 'mineru-processing' WHEN 1 THEN 'mineru-queued' WHEN 2 THEN 'result-fetching' WHEN 3 THEN 'upload' WHEN 4 THEN 'process' ELSE 'submit-failed-retryable' END AS stage,
          CASE WHEN o_orderkey % 10 = 0 THEN '提交失败，可重试' ELSE o_orderpriority END AS message, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE 'timeout' END AS error_message, o_orderdate AS created_at,
          '{"keep":"' || o_orderpriority || '"' || CASE WHEN o_custkey % 4 <> 0 THEN ',"mineruTaskId":"m' || CAST(o_orderkey AS STRING) || '"' ELSE '' END
            || CASE o_custkey % 3 WHEN 0 THEN ',"mineruStatus":"completed"' WHEN 1 THEN ',"mineruStatus":"processing"' ELSE '' END || CASE WHEN o_orderkey % 11 = 0 THEN ',"canceledAt":"2026-01-01"' ELSE '' END
            || CASE o_custkey % 5 WHEN 0 THEN ',"parsedFilesCount":0' WHEN 1 THEN ',"parsedFilesCount":3' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN ',"recoveredFromMisjudgedFailed":true' ELSE '' END
            || CASE o_custkey % 7 WHEN 0 THEN ',"previousErrorMessage":"older"' WHEN 1 THEN ',"previousErrorMessage":" "' ELSE '' END || '}' AS metadata
        FROM {orders}""",
    "patches": """
        SELECT 't' || CAST(l_orderkey AS STRING) AS id, CAST(l_linenumber AS BIGINT) * 10000000000 + CAST(l_partkey AS BIGINT) * 10000 + l_suppkey AS nr,
          CASE l_partkey % 9 WHEN 0 THEN '{"stage":"s' || CAST(l_suppkey AS STRING) || '","metadata":{"mineruStatus":null,"extra":' || CAST(l_partkey AS STRING) || '}}' WHEN 1 THEN '{"message":null}' WHEN 2 THEN '{"metadata":null,"stage":""}'
            WHEN 3 THEN '{"stage":"a","metadata":{"keep":"k' || CAST(l_suppkey AS STRING) || '","extra":{"x":[1,"' || CAST(l_partkey AS STRING) || '"]}},"stage":"b' || CAST(l_partkey AS STRING) || '"}' WHEN 4 THEN '{"stage":"cut off'
            WHEN 5 THEN '{"message":"m","metadata":{"extra":1}}{"message":"second"}' WHEN 6 THEN '{"metadata":"text","unknown":1}' WHEN 7 THEN ' {"metadata":{"mineruTaskId":123456789012345678901234567890}} ' ELSE '["stage"]' END AS body
        FROM {lineitem} WHERE l_orderkey % 3 <> 0""",
    "payloads": """
        SELECT 'p' || CAST(o_orderkey AS STRING) AS id,
          '{"results":' || CASE o_custkey % 6 WHEN 0 THEN '{"zeta":' WHEN 1 THEN '{"b":{"md_content":"not first"},"10":{"text":"no"},"2":' WHEN 2 THEN '[' WHEN 3 THEN '{"' || o_orderpriority || '":' WHEN 4 THEN '[null,' ELSE '{"x":{},"y":' END
            || CASE o_orderkey % 7 WHEN 0 THEN '{"md_content":" first ' || CAST(o_orderkey AS STRING) || ' "}' WHEN 1 THEN '{"md_content":null,"mdcontent":"second ' || CAST(o_custkey AS STRING) || '"}' WHEN 2 THEN '{"md_content":5,"mdContent":"hidden"}' WHEN 3 THEN '{"mdContent":"third"}' WHEN 4 THEN '"text"' WHEN 5 THEN '{"md_content":"  "}' ELSE 'null' END
            || CASE o_custkey % 6 WHEN 0 THEN ',"alpha":{"md_content":"not first either"}}' WHEN 1 THEN '}' WHEN 2 THEN ',{"md_content":"later"}]' WHEN 3 THEN '}' WHEN 4 THEN ']' ELSE '}' END
            || CASE o_orderkey % 5 WHEN 0 THEN ',"text":"own ' || CAST(o_orderkey AS STRING) || '"' WHEN 1 THEN ',"md_content":"","data":{"markdown":"inner ' || CAST(o_custkey AS STRING) || '"}' WHEN 2 THEN ',"data":[1,"",{"text":"no"},"listed"]' WHEN 3 THEN ',"output":{"md_text":7,"markdown":"out"}' ELSE '' END || '}' AS parsed,
          CASE WHEN o_orderkey % 3 = 0 THEN '{"descriptive_metadata":{"series_title":"lost"}}' WHEN o_orderkey % 3 = 1 THEN '{"primary_facets":null,"governance":{"confidence":"high"}}'
            ELSE '{"primary_facets":{"subject":{"zh":"s' || CAST(o_custkey % 5 AS STRING) || '"}},"normalized_tags":{"topic_tags":[' || CAST(o_orderkey AS STRING) || ',"t",true,{"zh":"","en":"e"},{"en":"only"}]},"system_tags":{"format_tags":["pdf",{"en":"x"},3]},"governance":{"confidence":"high"}}' END AS result
        FROM {orders}""",
    "drafts": """
        SELECT CAST(c_custkey AS STRING) AS id, CASE c_custkey % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'blob:x' ELSE 'http://p/' || CAST(c_custkey AS STRING) END AS preview,
          '{"provider":"' || CASE WHEN c_custkey % 2 = 0 THEN 'minio' ELSE 'other' END || '","objectName":"' || CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE 'originals/' || CAST(c_custkey AS STRING) END || '","fileUrl":"f","markdownUrl":"m"'
            || CASE WHEN c_custkey % 7 < 3 THEN ',"markdownObjectName":"' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'parsed' END || '"' ELSE '' END || CASE WHEN c_custkey % 11 = 0 THEN ',"localDraft":true' ELSE '' END
            || CASE WHEN c_custkey % 4 = 1 THEN ',"previewUrl":"blob:y"' ELSE ',"previewUrl":"z"' END || '}' AS metadata
        FROM {customer}""",
    "results": """
        SELECT DISTINCT id, file, 'parsed/' || id || '/' || file AS name, CASE WHEN file = 'full.md' THEN 10 ELSE length(file) * 7 END AS size,
          CASE WHEN file = 'mineru-result.zip' THEN n % 3 <> 0 WHEN file LIKE 'images/%' THEN n % 5 <> 0 ELSE TRUE END AS stored, file LIKE 'images/%' AND (n % 2 = 0 OR file NOT LIKE '%7.jpg') AS inside
        FROM (SELECT CAST(l_partkey % 400 AS STRING) AS id, l_partkey % 400 AS n,
            CASE l_linenumber WHEN 1 THEN 'mineru-result.zip' WHEN 2 THEN 'full.md' WHEN 3 THEN 'artifact-manifest.json' ELSE 'images/' || CAST(l_suppkey % 40 AS STRING) || '.jpg' END AS file FROM {lineitem}) AS files""",
    "papers": """
        SELECT 'p' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS k,
          '{"primary_facets":{"domain":"' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'D' || CAST(o_orderkey % 7 AS STRING) END || '","subject":{"zh":"' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '数学' END || '","en":"Math ' || CAST(o_custkey % 9 AS STRING)
            || '"},"stage":{"zh":"初中","en":""},"level":' || CASE WHEN o_orderkey % 4 = 0 THEN '{"zh":"","en":""}' ELSE '{"zh":"七' || CAST(o_custkey % 3 AS STRING) || '","en":"x"}' END || ',"component_role":{"en":"role"},"curriculum":" "},'
            || '"controlled_classification":{"subject":' || CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE '{"id":"s","zh":"科' || CAST(o_custkey % 11 AS STRING) || '"}' END || '},"descriptive_metadata":{"series_title":"' || CASE WHEN o_orderkey % 6 = 0 THEN o_orderpriority ELSE '' END || '","language":"'
            || CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE '' END || '"},"governance":{"confidence":"' || CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'odd' END || '","human_review_required":' || CASE WHEN o_custkey % 4 = 0 THEN 'true' ELSE 'false' END
            || '},"normalized_tags":{"topic_tags":["t' || CAST(o_custkey AS STRING) || '",{"zh":"标","en":"tag"},{"zh":"","en":"only"}]},"system_tags":{"format_tags":["pdf"]},"evidence":[' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '" plain ' || CAST(o_orderkey AS STRING) || ' ",' END
            || '{"type":"' || CASE o_custkey % 3 WHEN 0 THEN 'toc' WHEN 1 THEN 'odd' ELSE 'body' END || '","quote_or_summary":"' || CASE WHEN o_custkey % 4 = 0 THEN '  ' ELSE ' q ' || CAST(o_custkey AS STRING) END || '","supports":["a","b"]},3,null,""'
            || CASE WHEN o_orderkey % 8 = 0 THEN repeat(',{"type":"system","quote_or_summary":"again"}', 25) ELSE '' END || ']'
            || CASE WHEN o_orderkey % 3 <> 0 THEN ',"artifacts":[{"path":"a' || CAST(o_orderkey AS STRING) || '","base64":"QQ==","mimetype":"image/png"},{"path":"no content"}],"data":{"files":[{"name":"d' || CAST(o_orderkey AS STRING) || '","url":"HTTP://h/' || CAST(o_orderkey AS STRING)
              || '"}]},"results":[{"artifacts":[{"file_name":"r1","contentBase64":"Qg=="}],"files":[{"path":"hidden","url":"http://x"}]},{"files":[{"filename":"r2","Content-Type":" x/y ","downloadUrl":"https://h/r"},{"path":"bad","url":"ftp://x"}]}]' ELSE '' END || '}' AS body,
          CASE o_orderkey % 17 WHEN 0 THEN '" text ' || CAST(o_orderkey AS STRING) || ' "' WHEN 1 THEN '{"results":{"first":{"mdContent":"text ' || CAST(o_orderkey AS STRING) || '"},"second":{"md_content":"no"}}}' WHEN 2 THEN '[{"text":" text ' || CAST(o_orderkey AS STRING) || ' "}]'
            WHEN 3 THEN '{"data":[1,"text ' || CAST(o_orderkey AS STRING) || '","later"]}' WHEN 4 THEN '{"md_content":" ","data":{"text":7}}' WHEN 5 THEN '{"md_content":" ","output":{"markdown":"text ' || CAST(o_orderkey AS STRING) || '"}}'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN '{"data":{' ELSE '{' END || '"other":1,"' || CASE o_orderkey % 6 WHEN 0 THEN 'md_content' WHEN 1 THEN 'mdcontent' WHEN 2 THEN 'mdContent' WHEN 3 THEN 'md_text' WHEN 4 THEN 'markdown' ELSE 'text' END || '":"text ' || CAST(o_orderkey AS STRING) || '"'
              || CASE WHEN o_orderkey % 2 = 0 THEN '}}' ELSE '}' END END AS parsed
        FROM {orders}""",
}


def collection(spark: SparkSession, sf_dir: str, name: str, spread: str | None = None) -> DataFrame:
    """A stand-in; ``spread`` names a unique column by which its small source rows are dealt to the tasks before the long texts are made, as a small file is one task."""
    used = [t for t in ("customer", "orders", "lineitem") if "{" + t + "}" in SQL[name]]
    query = SQL[name]
    for brace in "{}":
        query = query.replace(brace, brace * 2)
    for t in used:
        query = query.replace("{{" + t + "}}", "{" + t + "}")
    rows = {t: table(spark, sf_dir, t) for t in used}
    return spark.sql(query, **{t: df.repartition(spread) if spread else df for t, df in rows.items()})


def with_collections(names: str, body: str) -> str:
    """``body`` with the named stand-ins in front, for DuckDB."""
    plain = lambda text: text.replace("{customer}", "customer").replace("{orders}", "orders").replace("{lineitem}", "lineitem")
    parts = [f"{n} AS ({plain(SQL[n])})" for n in names.split()]
    rest = body.strip()
    if rest[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + rest[5:]
    return "WITH " + ", ".join(parts) + " " + rest
