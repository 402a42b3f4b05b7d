"""Parser-log analytics: line classes, timestamp context, phase changes, activity level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The patterns of the signals, in the order of their priority.
PROGRESS = r"([a-zA-Z0-9\s_-]+?):\s*(\d+)%\|.*?\|\s*(\d+)/(\d+)"
TIMESTAMP = r"(\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2})"
WINDOW_LINE = r"(?i)Hybrid processing window\s+(\d+)/(\d+):\s*pages\s+(\d+)-(\d+)/(\d+)"
SIGNALS = (
    ("error", r"(?i)\b(?:RuntimeError|Exception|Traceback|OutOfMemoryError|CUDA\s*error|MPS\s+backend\s+out\s+of\s+memory|segfault|killed|torch\.cat|split_with_sizes|index\s+\S+\s+is\s+out\s+of\s+bounds|FATAL)\b"),
    ("error-signal", r"^\s*(?:Error|ERROR)\s*:"),
    ("window", WINDOW_LINE),
    ("document-shape", r"(?i)page_count\s*=\s*(\d+)|window_size\s*=\s*(\d+)|total_windows\s*=\s*(\d+)"),
    ("engine-config", r"(?i)Using\s+(transformers|pytorch|onnx)|hybrid\s+batch\s+ratio|batch_size\s*=|model_path\s*="),
    ("api-noise", r"""(?i)(?:GET|"GET)\s+/(?:health|tasks/[\w-]+)"""),
)
BUSINESS = ("window", "document-shape", "engine-config")

#: Lines of a source are grouped by ranges of ``seq`` of this width, so that a long log is not one task's.
RANGE = 1_000_000


def signal(line: Column) -> Column:
    """The class of a line, or null."""
    out = F.when(line.contains("%|") & line.rlike(PROGRESS), "progress")
    for name, pattern in SIGNALS:
        out = out.when(line.rlike(pattern), name)
    return F.when(F.trim(line) != "", out)


def progress(line: Column) -> dict[str, Column]:
    """Phase, percent, current and total of a progress line; nulls elsewhere."""
    hit = line.rlike(PROGRESS)
    number = lambda i: F.when(hit, F.regexp_extract(line, PROGRESS, i).try_cast("bigint"))
    return {"phase": F.when(hit, F.trim(F.regexp_extract(line, PROGRESS, 1))), "percent": number(2), "current": number(3), "total": number(4)}


def _stamp(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, TIMESTAMP, 1), F.lit(""))


def _range() -> Column:
    return F.floor(F.col("seq") / RANGE)


def marked(lines: DataFrame) -> DataFrame:
    """Lines with a class, their parts and their own time stamp. A line's class is found once: a filter on it would be run again below."""
    line = F.col("line")
    rows = lines.select("*", F.explode(F.array_compact(F.array(signal(line)))).alias("signal"))
    hit = F.col("signal") == "progress"
    return rows.withColumns({"stamp": _stamp(line), **{name: F.when(hit, part) for name, part in progress(line).items()}})


#: What an observation hands to the next one: the last time stamp, phase and window of a source, and the pages known so far.
WINDOW_PARTS = ("window_index", "window_total", "page_start", "page_end", "page_total")
CARRIED = "context string, phase string, window_index long, window_total long, page_start long, page_end long, page_total long, total_pages long"


def begins(previous: DataFrame, since: str | None = None) -> DataFrame:
    """What the next observation begins with: with ``since``, context and window only of observations that are not older."""
    if since is None:
        return previous
    fresh = F.replace("context", F.lit("T"), F.lit(" ")) >= since
    return previous.select(*(F.when(fresh, F.col(c)).alias(c) if c in ("context", *WINDOW_PARTS) else F.col(c) for c in previous.columns))


def _with_previous(rows: DataFrame, previous: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with columns of the row that ``previous`` has for their source, as ``_was_...``."""
    was = previous.select(F.col("source").alias("_was"), *(F.col(c).alias(f"_was_{c}") for c in columns))
    return rows.join(was, F.col("source").eqNullSafe(F.col("_was")), "left").drop("_was")


def classified(lines: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """``marked`` lines and the last time stamp seen in their source (``context``), which begins as ``previous`` (source, context) left it.

    Windows hold one range of lines each; what earlier ranges end with is joined to them.
    """
    line = F.col("line")
    kept = F.when(_stamp(line).isNotNull(), signal(line).isNotNull())
    ends = lines.groupBy("source", _range().alias("_range")).agg(F.max_by(_stamp(line), F.when(kept, F.col("seq"))).alias("_end"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier))
    if previous is not None:
        ends = _with_previous(ends, previous, ("context",)).withColumn("_before", F.coalesce("_before", "_was_context"))
    ends = ends.select(F.col("source").alias("_source"), F.col("_range").alias("_of"), "_before")
    upto = Window.partitionBy("source", "_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marked(lines).withColumn("_range", _range()).withColumn("context", F.last("stamp", ignorenulls=True).over(upto))
    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("_source")) & F.col("_range").eqNullSafe(F.col("_of")), "left")
    return rows.withColumn("context", F.coalesce("context", "_before")).drop("_range", "_source", "_of", "_before")


def segment(rows: DataFrame, since: str) -> DataFrame:
    """Lines of the current task: not older than ``since``; without any context only noise stays."""
    return rows.where(F.when(F.col("context").isNotNull(), F.replace("context", F.lit("T"), F.lit(" ")) >= since).otherwise(F.col("signal") == "api-noise"))


def phase_changes(rows: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Progress lines whose phase differs from the one before in their source, the first from that of ``previous`` (source, phase)."""
    lines = rows.where("signal = 'progress'").withColumn("_range", _range())
    ends = lines.groupBy("source", "_range").agg(F.max_by("phase", "seq").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("source").orderBy("_range")))
    if previous is not None:
        ends = _with_previous(ends, previous, ("phase",)).withColumn("_before", F.coalesce("_before", "_was_phase"))
    ends = ends.select(F.col("source").alias("_source"), F.col("_range").alias("_of"), "_before")
    inside = F.lag("phase").over(Window.partitionBy("source", "_range").orderBy("seq"))
    lines = lines.withColumn("_last", inside).join(ends, F.col("source").eqNullSafe(F.col("_source")) & F.col("_range").eqNullSafe(F.col("_of")), "left")
    return lines.where(F.coalesce("_last", "_before") != F.col("phase")).drop("_range", "_last", "_source", "_of", "_before")


def summary(rows: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Per source: counts of each kind of signal, the last progress and the pages of the last window or shape line.

    Lines are summed by ranges first; a source then has one row a range. With
    ``previous`` (source, phase, page_total, total_pages) the first phase is compared
    with the one before, and where no line tells the pages, those known before hold.
    """
    hit = F.col("signal") == "progress"
    n = lambda *kinds: F.count_if(F.col("signal").isin(*kinds))
    last = lambda kind, *parts: F.max(F.when(kind, F.struct("seq", *parts)))
    before = F.lag("phase").over(Window.partitionBy("source", "_range", hit).orderBy("seq"))
    pages = F.regexp_extract("line", r"(?i)page_count\s*=\s*(\d+)", 1)
    window_pages = F.regexp_extract("line", WINDOW_LINE, 5).try_cast("bigint").alias("pages")
    kinds = {"n_progress": ("progress",), "n_business": BUSINESS, "n_noise": ("api-noise",), "n_error": ("error",), "n_error_signal": ("error-signal",)}
    ranges = rows.withColumn("_range", _range()).withColumn("_changed", hit & (before != F.col("phase"))).groupBy("source", "_range").agg(
        *(n(*k).alias(name) for name, k in kinds.items()), F.count_if("_changed").alias("n_changes"), F.min(F.when(hit, F.struct("seq", "phase"))).alias("first"), last(hit, "phase", "percent", "current", "total").alias("last"),
        last(F.col("signal") == "window", window_pages).alias("window"), last((F.col("signal") == "document-shape") & (pages != ""), pages.try_cast("bigint").alias("pages")).alias("shape"),
    )
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    step = F.last("last.phase", ignorenulls=True).over(earlier) != F.col("first.phase")
    whole = ranges.withColumn("_step", step).groupBy("source").agg(
        *(F.sum(name).alias(name) for name in kinds), (F.sum("n_changes") + F.count_if("_step")).alias("n_changes"), F.max("last").alias("last"), F.max("window").alias("window"), F.max("shape").alias("shape"), F.min("first").alias("first")
    )
    pages = F.coalesce("window.pages", "shape.pages")
    if previous is not None:
        whole = _with_previous(whole, previous, ("phase", "page_total", "total_pages"))
        whole = whole.withColumn("n_changes", F.col("n_changes") + F.coalesce(F.col("_was_phase") != F.col("first.phase"), F.lit(False)).cast("long"))
        pages = F.coalesce("window.pages", "_was_page_total", "shape.pages", "_was_total_pages")
    return whole.select("source", "n_progress", "n_changes", "n_business", "n_noise", "n_error", "n_error_signal", "last.phase", "last.percent", "last.current", "last.total", pages.alias("total_pages"))


def carried(rows: DataFrame, segment_rows: DataFrame, previous: DataFrame) -> DataFrame:
    """What an observation leaves for the next one, of every source in it or in ``previous``.

    ``rows`` are its ``classified`` lines, ``segment_rows`` those of the current task.
    """
    parts = F.struct("seq", *(F.regexp_extract("line", WINDOW_LINE, k).try_cast("bigint").alias(c) for k, c in enumerate(WINDOW_PARTS, 1)))
    stamps = rows.groupBy("source").agg(F.max_by("context", "seq").alias("context"))
    seen = segment_rows.groupBy("source").agg(F.max(F.when(F.col("signal") == "progress", F.struct("seq", "phase"))).alias("progress"), F.max(F.when(F.col("signal") == "window", parts)).alias("window"))
    known = summary(segment_rows, previous).select(F.col("source").alias("_s"), "total_pages")
    seen = seen.join(known, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_s"), "progress", "window", "total_pages")
    new = stamps.join(seen, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_new"), F.lit(True).alias("_seen"), F.col("context").alias("_context"), "progress", "window", F.col("total_pages").alias("_pages"))
    both = previous.join(new, F.col("source").eqNullSafe(F.col("_new")), "full")
    window = [F.when(F.col("window").isNotNull(), F.col(f"window.{c}")).otherwise(F.col(c)).alias(c) for c in WINDOW_PARTS]
    return both.select(F.when(F.col("_seen"), F.col("_new")).otherwise(F.col("source")).alias("source"), F.coalesce("_context", "context").alias("context"), F.coalesce("progress.phase", "phase").alias("phase"), *window, F.coalesce("_pages", "total_pages").alias("total_pages"))


def observed(lines: DataFrame, previous: DataFrame, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """An observation of the lines that came since ``previous`` (source, ``CARRIED``): the summary, and what the next one begins with.

    A log that is observed in parts gives the contexts, the phase changes and the pages
    of the whole. ``since`` is the start of the current task: older lines, and context and
    window of an older observation, do not count.
    """
    begin = begins(previous, since)
    rows = classified(lines, begin)
    own = rows if since is None else segment(rows, since)
    return summary(own, begin), carried(rows, own, begin)


def activity(unchanged: Column) -> Column:
    """The raw activity level of a summary; ``unchanged`` tells whether the progress equals the previous observation's."""
    c = F.col
    stalled = F.when(c("n_changes") > 0, "active-stage-change").when(c("n_business") > 0, "active-business-log").otherwise("suspected-stale")
    return (
        F.when(c("n_error") > 0, "log-error-signal")
        .when((c("n_progress") > 0) & unchanged, stalled)
        .when(c("n_progress") > 0, "active-progress")
        .when(c("n_changes") > 0, "active-stage-change")
        .when(c("n_business") > 0, "active-business-log")
        .when(c("n_noise") > 0, "api-alive-only")
        .otherwise("no-business-signal")
    )


def reported(level: Column) -> Column:
    return F.when(level == "no-business-signal", "log-observation-no-business-signal").otherwise(level)


def units(profile: Column, phase: Column, total: Column, window: Column, window_pages: Column, pages: Column) -> Column:
    """What a progress line counts, by backend profile and phase."""
    hybrid = profile.contains("hybrid")
    predict = F.when(total == window, "window-pages").when(total == window_pages, "document-pages").when(total == pages, "document-pages").otherwise("model-units")
    in_hybrid = F.when(F.lower(phase).contains("predict"), predict).when(phase.contains("OCR"), "ocr-recognition-blocks")
    layout = phase.isin("Processing pages", "Layout") | phase.contains("Predict Layout") | phase.contains("Layout Predict")
    other = F.when(layout, "document-pages").when(phase.contains("Table"), "table-regions").when(phase.contains("OCR"), "ocr-recognition-blocks").when(phase == "Seal", "seal-units").when(total == pages, "document-pages")
    return F.coalesce(F.when(hybrid, in_hybrid).otherwise(other), F.lit("unknown-units"))


def best_source(observations: DataFrame) -> DataFrame:
    """Of several log files of a task the one with a business signal, then the latest business time, then the latest change."""
    order = Window.partitionBy("task").orderBy(F.col("has_business").desc(), F.col("business_time").desc_nulls_last(), F.col("mtime").desc(), "source")
    return observations.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def freshness(mtime: Column, started: Column, now: Column, level: Column, stale_seconds: int = 120) -> Column:
    """unattributed if the file is older than the task, stale if it is quiet for too long without an error, else fresh."""
    old = F.unix_timestamp(now) - F.unix_timestamp(mtime) > stale_seconds
    return F.when(mtime < started, "unattributed").when(old & (level != "log-error-signal"), "stale").otherwise("fresh")
