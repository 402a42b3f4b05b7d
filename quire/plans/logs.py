"""Log analytics over the stand-in log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import logs
from quire.plans.proxies import collection, with_collections
from quire.sources import table

_P = r"([a-zA-Z0-9\s_-]+?):\s*(\d+)%\|.*?\|\s*(\d+)/(\d+)"
_SIGNAL = rf"""CASE WHEN trim(line) = '' THEN NULL WHEN regexp_matches(line, '{_P}') THEN 'progress'
  WHEN regexp_matches(line, '(?i)\b(RuntimeError|Exception|Traceback|OutOfMemoryError|CUDA\s*error|MPS\s+backend\s+out\s+of\s+memory|segfault|killed|torch\.cat|split_with_sizes|index\s+\S+\s+is\s+out\s+of\s+bounds|FATAL)\b') THEN 'error'
  WHEN regexp_matches(line, '^\s*(Error|ERROR)\s*:') THEN 'error-signal'
  WHEN regexp_matches(line, '(?i)Hybrid processing window\s+(\d+)/(\d+):\s*pages\s+(\d+)-(\d+)/(\d+)') THEN 'window'
  WHEN regexp_matches(line, '(?i)page_count\s*=\s*(\d+)|window_size\s*=\s*(\d+)|total_windows\s*=\s*(\d+)') THEN 'document-shape'
  WHEN regexp_matches(line, '(?i)Using\s+(transformers|pytorch|onnx)|hybrid\s+batch\s+ratio|batch_size\s*=|model_path\s*=') THEN 'engine-config'
  WHEN regexp_matches(line, '(?i)(GET|"GET)\s+/(health|tasks/[\w-]+)') THEN 'api-noise' END"""
_X = lambda i, cast: f"CASE WHEN signal = 'progress' THEN CAST({'trim(' if cast == 'VARCHAR' else ''}regexp_extract(line, '{_P}', {i}){')' if cast == 'VARCHAR' else ''} AS {cast}) END"
ROWS = rf"""s AS (SELECT *, {_SIGNAL} AS signal FROM log_lines), p AS (SELECT *, nullif(regexp_extract(line, '(\d{{4}}-\d{{2}}-\d{{2}}[\sT]\d{{2}}:\d{{2}}:\d{{2}})', 1), '') AS stamp,
  {_X(1, "VARCHAR")} AS phase, {_X(2, "BIGINT")} AS percent, {_X(3, "BIGINT")} AS current, {_X(4, "BIGINT")} AS total FROM s WHERE signal IS NOT NULL),
  c AS (SELECT *, last_value(stamp IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM p)"""
SUM = r"""m AS (SELECT *, signal = 'progress' AND coalesce(lag(CASE WHEN signal = 'progress' THEN phase END) OVER (PARTITION BY source, signal = 'progress' ORDER BY seq) <> phase, false) AS changed,
  nullif(regexp_extract(line, '(?i)page_count\s*=\s*(\d+)', 1), '') AS shape FROM c),
  g AS (SELECT source, count(*) FILTER (signal = 'progress') AS n_progress, count(*) FILTER (changed) AS n_changes, count(*) FILTER (signal IN ('window', 'document-shape', 'engine-config')) AS n_business,
    count(*) FILTER (signal = 'api-noise') AS n_noise, count(*) FILTER (signal = 'error') AS n_error, count(*) FILTER (signal = 'error-signal') AS n_error_signal,
    arg_max(phase, seq) FILTER (signal = 'progress') AS phase, arg_max(percent, seq) FILTER (signal = 'progress') AS percent, arg_max(current, seq) FILTER (signal = 'progress') AS current, arg_max(total, seq) FILTER (signal = 'progress') AS total,
    coalesce(arg_max(TRY_CAST(regexp_extract(line, '(?i)Hybrid processing window\s+(\d+)/(\d+):\s*pages\s+(\d+)-(\d+)/(\d+)', 5) AS BIGINT), seq) FILTER (signal = 'window'), arg_max(CAST(shape AS BIGINT), seq) FILTER (signal = 'document-shape' AND shape IS NOT NULL)) AS total_pages
    FROM m GROUP BY source)"""
_SINCE = "2026-04-25 03:00:00"


def _rows(spark, sf_dir):
    return logs.classified(collection(spark, sf_dir, "log_lines"))


def _marked(spark, sf_dir):
    return logs.marked(collection(spark, sf_dir, "log_lines"))


def classes(spark, sf_dir):
    return _rows(spark, sf_dir).select("seq", "signal", "stamp", "phase", "percent", "current", "total", "context")


def segments(spark, sf_dir):
    return logs.segment(_rows(spark, sf_dir), _SINCE).groupBy("source", "signal").agg(F.count("*").alias("n"))


def changes(spark, sf_dir):
    return logs.phase_changes(_marked(spark, sf_dir)).select("source", "seq", "phase")


def levels(spark, sf_dir):
    level = logs.activity(F.coalesce(F.col("source") % 3 == 0, F.lit(False)))
    return logs.summary(_marked(spark, sf_dir)).withColumn("level", logs.reported(level))


def quiet_levels(spark, sf_dir):
    quiet = _marked(spark, sf_dir).where("signal not in ('error', 'progress') and (source % 4 <> 1 or signal = 'api-noise')")
    return logs.summary(quiet).select("source", logs.reported(logs.activity(F.lit(False))).alias("level"))


def unit_types(spark, sf_dir):
    rows = logs.summary(_marked(spark, sf_dir))
    profile = F.when(F.col("source") % 2 == 0, "hybrid-auto-engine").otherwise("pipeline")
    return rows.select("source", logs.units(profile, F.col("phase"), F.col("total"), F.lit(4), F.lit(27), F.col("total_pages")).alias("unit"))


def sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("task"), F.col("o_orderkey").alias("source"), (F.col("o_orderpriority") < "3").alias("has_business"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("business_time"), F.col("o_totalprice").alias("mtime"),
    )
    return logs.best_source(o).select("task", "source")


def fresh(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mtime = F.timestamp_seconds(F.col("o_orderkey") % 1000)
    state = logs.freshness(mtime, F.timestamp_seconds(F.lit(100)), F.timestamp_seconds(F.lit(700)), F.when(F.col("o_custkey") % 5 == 0, "log-error-signal").otherwise("active-progress"))
    return o.select("o_orderkey", state.alias("freshness"))


QUERIES = {
    "l1_l2_w4_line_classes": (classes, with_collections("log_lines", f"WITH {ROWS} SELECT seq, signal, stamp, phase, percent, current, total, context FROM c")),
    "l3_task_segment": (segments, with_collections("log_lines", f"WITH {ROWS} SELECT source, signal, count(*) AS n FROM c WHERE CASE WHEN context IS NOT NULL THEN replace(context, 'T', ' ') >= '{_SINCE}' ELSE signal = 'api-noise' END GROUP BY source, signal")),
    "w5_phase_changes": (changes, with_collections("log_lines", f"WITH {ROWS} SELECT source, seq, phase FROM (SELECT *, lag(phase) OVER (PARTITION BY source ORDER BY seq) AS before FROM c WHERE signal = 'progress') WHERE before <> phase")),
    "l4_l6_a11_activity": (
        levels,
        with_collections(
            "log_lines",
            f"""WITH {ROWS}, {SUM} SELECT *, CASE WHEN n_error > 0 THEN 'log-error-signal' WHEN n_progress > 0 AND source % 3 = 0 THEN CASE WHEN n_changes > 0 THEN 'active-stage-change' WHEN n_business > 0 THEN 'active-business-log' ELSE 'suspected-stale' END
              WHEN n_progress > 0 THEN 'active-progress' WHEN n_changes > 0 THEN 'active-stage-change' WHEN n_business > 0 THEN 'active-business-log' WHEN n_noise > 0 THEN 'api-alive-only' ELSE 'log-observation-no-business-signal' END AS level FROM g""",
        ),
    ),
    "l4_quiet_activity": (
        quiet_levels,
        with_collections(
            "log_lines",
            f"""WITH {ROWS} SELECT source, CASE WHEN count(*) FILTER (signal IN ('window', 'document-shape', 'engine-config')) > 0 THEN 'active-business-log' WHEN count(*) FILTER (signal = 'api-noise') > 0 THEN 'api-alive-only'
              ELSE 'log-observation-no-business-signal' END AS level FROM c WHERE signal NOT IN ('error', 'progress') AND (source % 4 <> 1 OR signal = 'api-noise') GROUP BY source""",
        ),
    ),
    "l5_unit_types": (
        unit_types,
        with_collections(
            "log_lines",
            f"""WITH {ROWS}, {SUM} SELECT source, coalesce(CASE WHEN source % 2 = 0 THEN CASE WHEN contains(lower(phase), 'predict') THEN CASE WHEN total = 4 THEN 'window-pages' WHEN total = 27 THEN 'document-pages' WHEN total = total_pages THEN 'document-pages' ELSE 'model-units' END
                WHEN contains(phase, 'OCR') THEN 'ocr-recognition-blocks' END
              ELSE CASE WHEN phase IN ('Processing pages', 'Layout') OR contains(phase, 'Predict Layout') OR contains(phase, 'Layout Predict') THEN 'document-pages' WHEN contains(phase, 'Table') THEN 'table-regions' WHEN contains(phase, 'OCR') THEN 'ocr-recognition-blocks'
                WHEN phase = 'Seal' THEN 'seal-units' WHEN total = total_pages THEN 'document-pages' END END, 'unknown-units') AS unit FROM g""",
        ),
    ),
    "l7_best_source": (
        sources,
        "SELECT o_custkey % 40 AS task, o_orderkey AS source FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderpriority < '3' DESC, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END DESC NULLS LAST, o_totalprice DESC, o_orderkey) = 1",
    ),
    "l8_freshness": (fresh, "SELECT o_orderkey, CASE WHEN o_orderkey % 1000 < 100 THEN 'unattributed' WHEN 700 - o_orderkey % 1000 > 120 AND o_custkey % 5 <> 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM orders"),
}
