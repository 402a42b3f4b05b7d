"""Text functions over ``documents`` and made-up names (T and D families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import within
from quire.operators import text
from quire.sources import table

_TRIM = "' ' || chr(10) || chr(9) || chr(13)"
_NAME = "'dir\\x/./' || source || '/../' || lang || ' Book_(' || CAST(doc_id AS VARCHAR) || ')-final' || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.md' ELSE '.tar.gz' END"


def _d(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    end = F.when(F.col("doc_id") % 4 == 0, ".PDF").when(F.col("doc_id") % 4 == 1, ".docx").when(F.col("doc_id") % 4 == 2, ".md").otherwise(".tar.gz")
    name = F.concat(F.lit("dir\\x/./"), "source", F.lit("/../"), "lang", F.lit(" Book_("), F.col("doc_id").cast("string"), F.lit(")-final"), end)
    marked = F.concat(F.when(F.col("doc_id") % 3 == 0, "# Title one\n1. First part\n").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "Table of Contents\n").otherwise(""), "text")
    return docs.select("doc_id", marked.alias("text"), name.alias("name"), "source", "lang", "n_chars")


_ROWS = f"d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# Title one' || chr(10) || '1. First part' || chr(10) ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'Table of Contents' || chr(10) ELSE '' END || text AS text, {_NAME} AS name, source, lang, n_chars FROM documents)"
_SNIP = lambda p: f"trim(substr(text, CAST(floor(length(text) * {p}::DOUBLE) AS BIGINT) + 1, 1500), {_TRIM})"
_HEADS = r"""list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^(#{1,6}|\d+\.)\s+(.+)')), lambda x: left(x, 200))[1:120]"""
_TOC = "coalesce(nullif(left(regexp_extract(text, '(?is)((?:contents|table of contents|目录).{100,1000}.{0,1000})', 1), 2000), ''), 'not_found')"
_TAIL = "CASE WHEN length(text) < 5000 THEN right(text, 1000) ELSE right(text, 3000) END"
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(name, '(?i)\.(pdf|docx?|zip|pptx?|epub)$', ''), '[_\-()\[\]\s]+'), lambda t: length(t) > 2)"
_PACK = " || ".join(
    f"'=== {t} ===' || chr(10) || {b} || chr(10) || chr(10)"
    for t, b in (
        ("FILENAME SIGNALS", f"array_to_string({_TOKENS}, ' | ')"),
        ("DOCUMENT SHAPE", f"'markdown_chars: ' || CAST(length(text) AS VARCHAR) || chr(10) || 'heading_count: ' || CAST(len({_HEADS}) AS VARCHAR) || chr(10) || 'toc_detected: ' || CAST({_TOC} <> 'not_found' AS VARCHAR)"),
        ("TITLE / FRONT MATTER", "left(text, 3000)"), ("TOC / CONTENTS", _TOC), ("HEADING OUTLINE", f"coalesce(array_to_string({_HEADS}, chr(10)), '')"),
        ("EARLY BODY", _SNIP(0.1)), ("MIDDLE CHAPTER", _SNIP(0.5)), ("LATE CHAPTER", _SNIP(0.8)), ("TAIL", _TAIL),
    )
)
_LIMIT = 2000


def outline(spark, sf_dir):
    d = _d(spark, sf_dir)
    return d.select("doc_id", F.array_join(text.headings(F.col("text")), "|").alias("headings"), F.md5(text.toc(F.col("text"))).alias("toc"), F.array_join(text.name_tokens(F.col("name")), "|").alias("tokens"))


def snippets(spark, sf_dir):
    t = F.col("text")
    return _d(spark, sf_dir).select("doc_id", *(F.md5(text.snippet(t, p)).alias(n) for n, p in (("early", 0.1), ("middle", 0.5), ("late", 0.8))), F.md5(text.tail(t)).alias("tail"))


def packs(spark, sf_dir):
    got = text.evidence_pack(F.col("text"), F.col("name"), 6000)
    return _d(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in got.items()))


def _header():
    return F.concat(F.lit("=== FILE METADATA ===\nFilename: "), "source", F.lit("\n=== END METADATA ===\n\n"))


def samples(spark, sf_dir):
    return _d(spark, sf_dir).select("doc_id", F.md5(text.sample(F.col("text"), _header(), _LIMIT)).alias("sampled"))


def whole_packs(spark, sf_dir):
    got = text.evidence_pack(F.col("text"), F.col("name"))
    return _d(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in got.items()))


_FACTS_SQL = "CASE WHEN doc_id % 6 = 0 THEN '' ELSE name END AS file_name, doc_id * 10 AS file_size, CASE WHEN doc_id % 2 = 0 THEN 'application/pdf' ELSE '' END AS mime_type, CASE WHEN doc_id % 5 > 0 THEN doc_id % 2000 END AS files, 'raw/' || CAST(doc_id AS STRING) AS raw_object_name, CASE WHEN doc_id % 4 > 0 THEN 'full.md' END AS markdown_object_name"
_NAMED = "(CASE WHEN file_name = '' THEN raw_object_name ELSE file_name END)"
_SIGNALS = f"array_to_string({_TOKENS.replace('(name,', f'({_NAMED},')}, ' | ')"
_WHOLE_PACK = " || chr(10) || chr(10) || ".join(
    f"'=== {t} ===' || chr(10) || {b}"
    for t, b in (
        ("SOURCE FACTS", f"'file_name: ' || {_NAMED} || chr(10) || 'file_size: ' || file_size || chr(10) || 'mime_type: ' || mime_type || chr(10) || 'parsed_files_count: ' || coalesce(files, 0) || chr(10) || 'raw_object_name: ' || raw_object_name || chr(10) || 'markdown_object_name: ' || coalesce(markdown_object_name, '')"),
        ("FILENAME SIGNALS", _SIGNALS),
        ("DOCUMENT SHAPE", f"'markdown_chars: ' || length(text) || chr(10) || 'estimated_pages: ' || coalesce(files, 0) || chr(10) || 'large_document: ' || CAST(length(text) > 150000 OR coalesce(files, 0) > 1000 AS VARCHAR) || chr(10) || 'heading_count: ' || len({_HEADS}) || chr(10) || 'toc_detected: ' || CAST({_TOC} <> 'not_found' AS VARCHAR)"),
        ("TITLE / FRONT MATTER", "left(text, 3000)"), ("TOC / CONTENTS", _TOC), ("HEADING OUTLINE", f"coalesce(array_to_string({_HEADS}, chr(10)), '')"),
        ("REPRESENTATIVE BODY SNIPPETS", f"'--- EARLY BODY ---' || chr(10) || {_SNIP(0.1)} || chr(10) || chr(10) || '--- MIDDLE CHAPTER ---' || chr(10) || {_SNIP(0.5)} || chr(10) || chr(10) || '--- LATE CHAPTER ---' || chr(10) || {_SNIP(0.8)}"),
        ("TAIL / APPENDIX / ANSWER SIGNALS", _TAIL), ("EVIDENCE CANDIDATES", _SIGNALS),
    )
) + " || chr(10)"


def source_packs(spark, sf_dir):
    d = spark.sql(f"SELECT *, {_FACTS_SQL} FROM {{d}}", d=_d(spark, sf_dir))
    pack = text.whole_pack(F.col("text"), {k: F.col("files" if k == "parsed_files_count" else k) for k in text.FACTS})
    return d.select("doc_id", F.length(pack).alias("pack_chars"), F.concat(F.lit("sha256:"), F.sha2(pack, 256)).alias("input_hash"))


def whole_samples(spark, sf_dir):
    return _d(spark, sf_dir).select("doc_id", F.md5(text.sample(F.col("text"), _header())).alias("sampled"))


def choices(spark, sf_dir):
    got = text.model_input(F.col("text"), F.col("name"), _header(), F.col("doc_id") * 37 % 2000)
    d = _d(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in got.items()))
    return d.select("doc_id", "mode", F.length("content").alias("chars"), F.md5("content").alias("content"), "truncated")


def contexts(spark, sf_dir):
    got = text.context(F.repeat("text", 6), 5)
    return _d(spark, sf_dir).select("doc_id", F.length(got).alias("chars"), F.md5(got).alias("context"))


def thinking(spark, sf_dir):
    raw = F.concat(F.lit("<think>a\nb</think> {"), "text", F.when(F.col("doc_id") % 2 == 0, "}").otherwise("<THINK> open"))
    got = text.without_thinking(raw)
    return _d(spark, sf_dir).select("doc_id", F.md5(got).alias("text"), text.looks_truncated(got).alias("truncated"), F.md5(text.one_line(F.col("text"))).alias("one_line"))


def names(spark, sf_dir):
    n = F.col("name")
    return _d(spark, sf_dir).select(
        "doc_id", text.file_format(F.when(F.col("doc_id") % 7 == 0, "image/png"), n).alias("format"), text.content_type(n).alias("content_type"), text.safe_path(n).alias("refused"), text.safe_path(F.regexp_replace(n, r"\.\./", "")).alias("path"),
        text.safe_name(F.concat(n, F.lit(' a:b?"c  '))).alias("file"), F.substring_index(n, "/", -1).alias("base"),
    )


def mojibake(spark, sf_dir):
    broken = F.decode(F.encode(F.concat(F.lit("学年"), F.col("doc_id").cast("string")), "UTF-8"), "ISO-8859-1")
    name = F.when(F.col("doc_id") % 3 == 0, broken).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Café "), "lang")).otherwise(F.col("lang"))
    return _d(spark, sf_dir).select("doc_id", text.repaired_name(name).alias("name"))


def numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    k = F.col("o_orderkey") * 7919 % 20_000_003
    return o.select(
        "o_orderkey", text.duration_text((k - 1000) * 3).alias("took"), text.timeout_ms(k % 9000).alias("timeout"), text.confidence(F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium")).alias("confidence"), within(k % 300 - 100, 0, 100).alias("clamped"),
        F.when(k < 1024, F.concat(k.cast("string"), F.lit(" B"))).otherwise("more").alias("small"), F.try_divide(k % 1000, k % 7).alias("ratio"), F.greatest(F.lit(0), 500 - k % 1000).alias("left_over"),
        F.unix_millis("o_orderdate").alias("ms"), F.date_format(F.timestamp_millis(F.unix_millis("o_orderdate")), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (F.unix_timestamp(F.lit("1997-06-01").cast("timestamp")) - F.unix_timestamp("o_orderdate") > 660).alias("overdue"),
    )


def expiry(spark, sf_dir):
    url = F.concat(F.lit("https://s/x?X-Amz-Date=2026"), F.lpad((F.col("o_orderkey") % 12 + 1).cast("string"), 2, "0"), F.lit("05T101500Z&X-Amz-Expires="), (F.col("o_orderkey") % 5000).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.url_expiry(url).alias("expires"))




def _packed(limit):
    return rf"p AS (SELECT doc_id, {_PACK} AS p FROM d), c AS (SELECT doc_id, CASE WHEN length(p) > {limit} THEN left(p, {limit}) || '\n...[Evidence Pack Truncated]' ELSE p END AS p FROM p)"


def _sampled(limit):
    """The steps of the sampler, and its result over the last of them."""
    room = f"({limit} - length(header) - 150)"
    return (
        f"""h AS (SELECT *, '=== FILE METADATA ===' || chr(10) || 'Filename: ' || source || chr(10) || '=== END METADATA ===' || chr(10) || chr(10) AS header FROM d),
        s AS (SELECT *, {room} AS room, length(text) AS n, CAST(floor({room} * 0.2::DOUBLE) AS BIGINT) AS head, CAST(floor({room} * 0.1::DOUBLE) AS BIGINT) AS tenth, regexp_extract(text, '(?i)(目录|TOC|Table of Contents|CONTENTS)', 1) AS hit FROM h),
        a AS (SELECT *, room - head - 2 * tenth AS middle, CASE WHEN hit = '' THEN -1 ELSE instr(text, hit) - 1 END AS pos FROM s),
        b AS (SELECT *, greatest(0, pos - CAST(floor(tenth / 4) AS BIGINT)) AS near FROM a)""",
        """CASE WHEN n = 0 THEN '' WHEN n <= room THEN header || text ELSE array_to_string([header, '=== HEAD ===', left(text, head), chr(10) || '=== TOC/NEAR HEAD ===',
          CASE WHEN pos >= 0 THEN substr(text, near + 1, least(n, pos + CAST(floor(tenth * 0.75::DOUBLE) AS BIGINT)) - near) ELSE substr(text, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) + 1, tenth) END, chr(10) || '=== MIDDLE ===',
          substr(text, CAST(floor(n / 2 - middle / 2) AS BIGINT) + 1, middle), chr(10) || '=== TAIL ===', right(text, tenth), chr(10) || '=== ARTIFACT SIGNAL ===' || chr(10) || '[sampled representation]'], chr(10)) END""",
    )


QUERIES = {
    "t7_t8_t9_outline": (outline, f"WITH {_ROWS} SELECT doc_id, coalesce(array_to_string({_HEADS}, '|'), '') AS headings, md5({_TOC}) AS toc, array_to_string({_TOKENS}, '|') AS tokens FROM d"),
    "t10_t11_snippets": (snippets, f"WITH {_ROWS} SELECT doc_id, md5({_SNIP(0.1)}) AS early, md5({_SNIP(0.5)}) AS middle, md5({_SNIP(0.8)}) AS late, md5({_TAIL}) AS tail FROM d"),
    # small caps, so that short texts are cut as well
    "t12_t14_evidence_pack": (packs, f"WITH {_ROWS}, {_packed(6000)} SELECT doc_id, CAST(length(p) AS INT) AS pack_chars, 'sha256:' || sha256(p) AS input_hash FROM c"),
    "t13_sampler": (samples, "WITH {}, {}\n        SELECT doc_id, md5({}) AS sampled FROM b".format(_ROWS, *_sampled(_LIMIT))),
    # the caps of the reference
    "t12_whole_evidence_pack": (whole_packs, f"WITH {_ROWS}, {_packed(30_000)} SELECT doc_id, CAST(length(p) AS INT) AS pack_chars, 'sha256:' || sha256(p) AS input_hash FROM c"),
    "t12_source_pack": (
        source_packs,
        f"""WITH {_ROWS}, k AS (SELECT *, {_FACTS_SQL} FROM d), p AS (SELECT doc_id, {_WHOLE_PACK} AS p FROM k), c AS (SELECT doc_id, CASE WHEN length(p) > 30000 THEN left(p, 30000) || '\\n...[Evidence Pack Truncated]' ELSE p END AS p FROM p)
        SELECT doc_id, CAST(length(p) AS INT) AS pack_chars, 'sha256:' || sha256(p) AS input_hash FROM c""",
    ),
    "t13_whole_sampler": (whole_samples, "WITH {}, {}\n        SELECT doc_id, md5({}) AS sampled FROM b".format(_ROWS, *_sampled(80_000))),
    "t14_sampler_choice": (
        choices,
        "WITH {}, {}, {}, e AS (SELECT *, {} AS sampled, n > 150000 OR doc_id * 37 % 2000 > 1000 AS large FROM b), f AS (SELECT doc_id, n, large, CASE WHEN large THEN p ELSE sampled END AS content FROM e JOIN c USING (doc_id))\n"
        "        SELECT doc_id, CASE WHEN large THEN 'evidence-pack-v0.3' ELSE 'legacy-sampler-v0.2' END AS mode, CAST(length(content) AS INT) AS chars, md5(content) AS content, large OR n > length(content) AS truncated FROM f".format(_ROWS, _packed(30_000), *_sampled(80_000)),
    ),
    "t15_context": (contexts, f"WITH {_ROWS}, r AS (SELECT doc_id, repeat(text, 6) AS t FROM d), c AS (SELECT doc_id, CASE WHEN length(t) <= 10000 THEN t ELSE left(t, 6000) || chr(10) || chr(10) || '...[内容已截断]...' || chr(10) || chr(10) || right(t, 4000 - 17) END AS t FROM r) SELECT doc_id, CAST(length(t) AS INT) AS chars, md5(t) AS context FROM c"),
    "t16_t17_t18_clean_output": (
        thinking,
        rf"""WITH {_ROWS}, r AS (SELECT doc_id, text AS whole, '<think>a' || chr(10) || 'b</think> {{' || text || CASE WHEN doc_id % 2 = 0 THEN '}}' ELSE '<THINK> open' END AS raw FROM d),
        c AS (SELECT doc_id, whole, trim(regexp_replace(raw, '(?is)<think>.*?(?:</think>|$)', '', 'g'), {_TRIM}) AS text FROM r)
        SELECT doc_id, md5(text) AS text, contains(text, '{{') AND right(text, 1) NOT IN ('}}', ']') AS truncated, md5(trim(regexp_replace(whole, '\s+', ' ', 'g'))) AS one_line FROM c""",
    ),
    "t2_t6_names": (
        names,
        rf"""WITH {_ROWS}, e AS (SELECT *, lower(list_extract(string_split(name, '.'), -1)) AS ext, regexp_replace(replace(name, '\', '/'), '^/+', '') AS u, regexp_replace(replace(replace(name, '../', ''), '\', '/'), '^/+', '') AS v FROM d)
        SELECT doc_id, CASE WHEN ext = 'pdf' THEN 'PDF' WHEN doc_id % 7 = 0 THEN 'PNG' WHEN ext = 'docx' THEN 'DOCX' ELSE upper(ext) END AS format,
          CASE WHEN ext = 'pdf' THEN 'application/pdf' WHEN ext = 'md' THEN 'text/markdown; charset=utf-8' ELSE 'application/octet-stream' END AS content_type,
          CASE WHEN list_contains(string_split(u, '/'), '..') THEN '' ELSE u END AS refused, array_to_string(list_filter(string_split(v, '/'), lambda p: p NOT IN ('', '.')), '/') AS path,
          regexp_replace(regexp_replace(regexp_replace(name || ' a:b?"c  ', '[<>:"|?*\\/]', '_', 'g'), '\s+', '_', 'g'), '^_+|_+$', '', 'g') AS file, list_extract(string_split(name, '/'), -1) AS base FROM e""",
    ),
    "t1_mojibake": (mojibake, f"WITH {_ROWS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '学年' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'Café ' || lang ELSE lang END AS name FROM d"),
    "d1_d8_d10_numbers": (
        numbers,
        """WITH k AS (SELECT *, o_orderkey * 7919 % 20000003 AS k FROM orders), s AS (SELECT *, (k - 1000) * 3 AS ms3, (k - 1000) * 3 // 1000 AS s FROM k)
        SELECT o_orderkey, CASE WHEN ms3 <= 0 THEN '0s' WHEN s < 60 THEN s || 's' WHEN s // 60 < 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS took,
          CASE WHEN k % 9000 <= 3600 THEN k % 9000 * 1000 ELSE k % 9000 END AS timeout, CASE k % 3 WHEN 0 THEN 90 WHEN 1 THEN 60 ELSE 30 END AS confidence, greatest(0, least(100, k % 300 - 100)) AS clamped,
          CASE WHEN k < 1024 THEN k || ' B' ELSE 'more' END AS small, CASE WHEN k % 7 = 0 THEN NULL ELSE (k % 1000)::DOUBLE / (k % 7) END AS ratio, greatest(0, 500 - k % 1000) AS left_over,
          epoch_ms(o_orderdate) AS ms, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, epoch(TIMESTAMP '1997-06-01') - epoch(o_orderdate) > 660 AS overdue FROM s""",
    ),
    "d3_url_expiry": (expiry, "SELECT o_orderkey, CAST(epoch(make_timestamp(2026, o_orderkey % 12 + 1, 5, 10, 15, 0)) AS BIGINT) + o_orderkey % 5000 AS expires FROM orders"),
}
