"""Semi-structured model output: tolerant extraction, schema checks, validation, tags, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import blank, json_map, stripped, text_or, truthy
from quire.operators.text import without_thinking

#: Evidence types, confidence levels.
EVIDENCE_TYPES = ("filename", "title_page", "toc", "body", "system", "unknown")
CONFIDENCE = ("high", "medium", "low")


def extract_json(text: Column) -> Column:
    """The first of the whole text, a fenced block and the span from the first to the last brace that parses, as JSON text."""
    clean = without_thinking(text)
    fenced = F.trim(F.regexp_extract(clean, r"(?s)```(?:json)?\s*(.*?)\s*```", 1))
    first = F.instr(clean, "{")
    last = F.length(clean) - F.instr(F.reverse(clean), "}") + 1
    braces = F.when((first > 0) & (F.instr(F.reverse(clean), "}") > 0) & (last >= first), F.substr(clean, first, last - first + 1))
    valid = lambda c: F.when(truthy(c) & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(clean), valid(fenced), valid(braces))


def has_schema(json: Column) -> Column:
    """An object with the objects ``primary_facets`` and ``governance`` and the array ``evidence``."""
    v = F.try_parse_json(json)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce(kind("$.primary_facets").startswith("OBJECT") & kind("$.governance").startswith("OBJECT") & kind("$.evidence").startswith("ARRAY"), F.lit(False))


def evidence(rows: Column, most: int = 20) -> Column:
    """Typed, trimmed, non-empty evidence from (type, quote) structs; unknown types become ``unknown``."""
    clean = F.transform(rows, lambda e: F.struct(F.when(e["type"].isin(*EVIDENCE_TYPES), e["type"]).otherwise("unknown").alias("type"), F.trim(e["quote"]).alias("quote")))
    return F.slice(F.filter(clean, lambda e: truthy(e["quote"])), 1, most)


def system_tags(name: Column, mime: Column, backend: Column, ocr: Column, count: Column) -> Column:
    """Format, artifact and engine tags."""
    b = F.lower(backend)
    engine = F.when(b.contains("pipeline"), "pipeline").when(b.contains("hybrid"), "hybrid_auto_engine").when(b.contains("vlm"), "vlm_auto_engine")
    pdf = F.when(F.lower(name).endswith(".pdf") | F.coalesce(F.lower(mime).contains("pdf"), F.lit(False)), "pdf")
    return F.array_compact(F.array(pdf, F.when(ocr, "ocr_enabled"), F.when(count > 0, "has_parsed_artifacts"), F.when(count >= 50, "many_artifacts"), engine))


def governance(domain: Column, subject: Column, resource: Column, role: Column, level: Column, n_evidence: Column, n_proposed: Column, required: Column, reason: Column, parsed: Column) -> dict[str, Column]:
    """Confidence, review and risk of a classification, by the missing-value and review rules."""
    level = F.when(blank(domain), "low").when(level.isin(*CONFIDENCE), level).otherwise("low")
    flags = F.array_compact(F.array(F.when(blank(domain), "domain_missing"), F.when(blank(subject), "subject_missing"), F.when(blank(resource) & blank(role), "resource_type_missing"), F.when(n_evidence == 0, "evidence_missing")))
    review = F.coalesce(required, F.lit(False)) | (F.size(flags) > 0) | (level == "low") | (n_proposed > 0)
    why = F.when(truthy(reason), reason).when(n_proposed > 0, "Contains proposed new tags").when(review & (n_evidence == 0), "Evidence missing").when(review, "Review required")
    risk = F.array_distinct(F.concat(flags, F.array_compact(F.array(F.when(level == "low", "low_confidence"), F.when(review, "needs_human_review"), F.when(n_evidence == 0, "evidence_missing")))))
    return {"confidence": level, "risk_flags": flags, "review": review, "reason": why, "risk": risk, "quality": F.when(parsed == 0, "no_parsed_artifacts")}


def first_text(json: Column, paths: tuple[str, ...]) -> Column:
    """The first non-blank text among the given JSON paths."""
    return F.coalesce(*(F.when(F.trim(F.get_json_object(json, p)) != "", F.get_json_object(json, p)) for p in paths))


def primary_markdown(files: DataFrame) -> DataFrame:
    """One Markdown file per owner: full.md, else the only one, else the shortest path under /auto/, else the shortest."""
    low = F.lower("path")
    full = (low == "full.md") | low.endswith("/full.md")
    order = Window.partitionBy("owner").orderBy(full.desc(), F.when(full, F.lit(0)).otherwise(F.when(low.contains("/auto/"), 0).otherwise(1)), F.when(full, F.lit(0)).otherwise(F.length("path")), "ordinal")
    return files.where(low.endswith(".md")).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def distinct_artifacts(files: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first artifact of each composite key."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).where("_n = 1").drop("_n")


def artifact_flags(names: Column) -> dict[str, Column]:
    any_of = lambda end: F.exists(names, lambda n: n.endswith(end))
    return {"has_middle": any_of("_middle.json"), "has_model": any_of("_model.json"), "has_pdf": any_of(".pdf")}


def fallback(reason: Column, parsed: Column) -> dict[str, Column]:
    """Flags and signals of the skeleton that stands for a failed classification; the fallback flag occurs twice among the signals."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    parse = low.contains("json") | low.contains("parse") | low.contains("解析失败")
    repair = low.contains("repair") | low.contains("修复失败")
    flags = F.array_compact(F.array(F.lit("skeleton_fallback"), F.when(parse, "ai_provider_json_parse_failed"), F.when(repair, "ai_provider_json_repair_failed")))
    return {"risk_flags": flags, "risk": F.concat(flags, F.array(*map(F.lit, ("skeleton_fallback", "low_confidence", "needs_human_review")))), "quality": F.when(F.coalesce(parsed, F.lit(0)) == 0, "no_parsed_artifacts")}


VARIANTS = "array<variant>"


def _texts(v: Column, path: str = "$") -> Column:
    """The value at a path if it is a string: no other value of a variant can be cast to bytes."""
    return F.try_variant_get(v, path, "binary").cast("string")


def _list(v: Column, path: str = "$") -> Column:
    """The value at a path if it is an array, else an empty array."""
    return F.coalesce(F.try_variant_get(v, path, VARIANTS), F.from_json(F.lit("[]"), VARIANTS))


def evidence_of(json: Column, most: int = 20) -> Column:
    """Evidence (type, quote, supports) from a JSON array of texts and objects: texts have an unknown type, unknown types become ``unknown``, blank quotes go."""
    one = lambda v: F.struct(
        F.when(_texts(v, "$.type").isin(*EVIDENCE_TYPES), _texts(v, "$.type")).otherwise("unknown").alias("type"),
        stripped(F.coalesce(_texts(v), _texts(v, "$.quote_or_summary"), F.lit(""))).alias("quote"), F.coalesce(F.try_variant_get(v, "$.supports", "array<string>"), F.array().cast("array<string>")).alias("supports"),
    )
    return F.slice(F.filter(F.transform(_list(F.try_parse_json(json)), one), lambda e: e["quote"] != ""), 1, most)


#: Where the text of a parse result may stand, in order.
MARKDOWN_KEYS = ("md_content", "mdcontent", "mdContent", "md_text", "markdown", "text")
MARKDOWN_PATHS = (*(f"$.{k}" for k in MARKDOWN_KEYS), *(f"$.data.{k}" for k in MARKDOWN_KEYS), "$.output.md_text", "$.output.markdown")


def _at(v: Column, path: str) -> Column:
    """The value at a path, if there is one that is no JSON null."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) != "VOID", found)


def _first_key(json: Column, path: str) -> Column:
    """The first key of the object at a path as scripts count them: whole numbers first, by size, then the others as they stand in the text."""
    keys = F.json_object_keys(F.get_json_object(json, path))
    numbers = F.filter(keys, lambda k: k.rlike("^(0|[1-9][0-9]{0,9})$") & (k.try_cast("bigint") < 4294967295))
    least = F.array_min(F.transform(numbers, lambda k: k.try_cast("bigint"))).cast("string")
    return F.coalesce(least, F.get(keys, F.lit(0)))


def markdown_of(json: Column) -> Column:
    """The trimmed Markdown of a parse result.

    In this order: a JSON text; that of the first result, by place in the object or
    list, under the first of three keys that is not null, if it is a filled text; the
    text of the first listed part; the first filled text at the known paths or, as the
    first text of a list, under ``data``.
    """
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.results", "variant"))
    by_name = F.element_at(F.try_variant_get(v, "$.results", json_map.MAP), _first_key(json, "$.results"))
    result = F.when(kind.startswith("OBJECT"), by_name).when(kind.startswith("ARRAY"), F.try_variant_get(v, "$.results[0]", "variant"))
    named = json_map.let(result, lambda r: _texts(F.coalesce(*(_at(r, f"$.{k}") for k in MARKDOWN_KEYS[:3]))))
    part = F.try_element_at(_list(v), F.lit(1))
    listed = F.try_element_at(F.filter(_list(v, "$.data"), lambda x: F.schema_of_variant(x) == "STRING"), F.lit(1))
    filled = lambda c: F.when(stripped(c) != "", stripped(c))
    return F.coalesce(stripped(_texts(v)), filled(named), stripped(_texts(part, "$.text")), *(filled(_texts(v, p)) for p in MARKDOWN_PATHS), filled(_texts(listed)), F.lit(""))


#: Under what keys an artifact's parts may stand, in order.
ARTIFACT_NAMES = ("relativePath", "path", "name", "filename", "file_name")
ARTIFACT_TYPES = ("mimeType", "mimetype", "contentType", "Content-Type")
ARTIFACT_BYTES = ("base64", "content_base64", "data_base64", "contentBase64", "dataBase64")
ARTIFACT_URLS = ("url", "download_url", "downloadUrl", "presignedUrl")


def _counts(v: Column) -> Column:
    """A variant, if it counts as true: no null, empty text, zero or false."""
    plain = lambda kind: F.try_variant_get(v, "$", kind)
    nothing = lambda kind: F.when(kind == "VOID", True).when(kind == "STRING", plain("string") == "").otherwise(F.coalesce(plain("double") == 0, F.lit(False)))
    return F.when(json_map.let(F.schema_of_variant(v), lambda kind: ~nothing(kind)), v)


def _items(v: Column, path: str) -> Column:
    """The elements of the list at a path; a value that is no list is its only element, and what is not there or counts as false gives null."""
    return F.coalesce(F.try_variant_get(v, path, VARIANTS), json_map.let(_counts(F.try_variant_get(v, path, "variant")), lambda x: F.when(x.isNotNull(), F.array(x))))


def artifacts_of(rows: DataFrame, key: str, json: str) -> DataFrame:
    """One row per artifact of a parse result (key, path, media_type, source, content).

    They come from eight places, one after the other: lists of items, or one item. Of
    an element of ``results`` or ``data`` its ``artifacts`` count, however empty the
    list is, else its ``files``. An item needs a name, the first of its names that
    counts as true, which must be a filled text, and bytes or else an address. All is
    one expression under one generator, so a result is read once.
    """
    let = json_map.let
    none = F.from_json(F.lit("[]"), VARIANTS)
    inner = lambda v, path: F.flatten(F.transform(_list(v, path), lambda r: F.coalesce(_items(r, "$.artifacts"), _items(r, "$.files"), none)))
    places = ("$.artifacts", "$.files", "$.data.artifacts", "$.data.files", "$.results.artifacts", "$.results.files")
    every = lambda v: F.concat(*(F.coalesce(_items(v, p), none) for p in places), inner(v, "$.results"), inner(v, "$.data"))

    def one(item: Column, name: str) -> Column:
        """(text, any): the value as a text if it is one, and whatever it is; null if it does not count as true."""
        pair = lambda text, any: F.struct(text.alias("text"), any.alias("any"))
        some = lambda x: (x != "false") & F.coalesce(x.try_cast("double") != 0, F.lit(True))
        other = let(F.try_variant_get(item, f"$['{name}']", "string"), lambda x: F.when(some(x), pair(F.lit(None).cast("string"), x)))
        return let(_texts(item, f"$['{name}']"), lambda t: F.when(t != "", pair(t, t)).when(t.isNull(), other))

    def read(item: Column) -> Column:
        first = lambda names: F.coalesce(*(one(item, n) for n in names))
        return F.struct(first(ARTIFACT_NAMES)["text"].alias("path"), F.nullif(stripped(first(ARTIFACT_TYPES)["any"]), F.lit("")).alias("media_type"), first(ARTIFACT_BYTES)["text"].alias("bytes"), first(ARTIFACT_URLS)["text"].alias("url"))

    def row(nth: Column, r: Column) -> Column:
        source = F.when(stripped(r["bytes"]) != "", "bytes").when(r["url"].rlike(r"(?i)^https?://"), "url")
        return F.struct(nth.alias("nth"), r["path"].alias("path"), r["media_type"].alias("media_type"), source.alias("source"), F.when(stripped(r["bytes"]) != "", r["bytes"]).otherwise(r["url"]).alias("content"))

    found = lambda v: F.transform(every(v), lambda x, i: let(read(x), lambda r: row(i, r)))
    whole = F.filter(let(F.try_parse_json(json), found), lambda r: r["source"].isNotNull() & (stripped(r["path"]) != ""))
    return rows.select(key, F.inline(whole))


FACET_NAMES = ("domain", "collection", "curriculum", "stage", "level", "subject", "resource_type", "component_role")


def facet_values(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, name, value) of the facets of a result, whose values are texts or {zh, en}."""
    facets = F.try_variant_get(F.try_parse_json(json), "$.primary_facets", json_map.MAP)
    text = lambda path: F.nullif(_texts(F.col("v"), path), F.lit(""))
    found = rows.select(key, F.explode(facets).alias("name", "v")).where(F.col("name").isin(*FACET_NAMES))
    return found.select(key, "name", F.coalesce(text("$"), text("$.zh"), text("$.en")).alias("value")).where(F.trim("value") != "")


#: Fixed value: the title of a result without facets.
FAILED_TITLE = "解析失败"


def flattened(json: Column) -> dict[str, Column]:
    """What the catalog shows of a classification: controlled values before raw ones, a summary, one list of tags, a confidence in percent and whether to review.

    A result without facets has the title that says so, no subject and no grade, and
    nothing else.
    """
    found = _flat(json)
    return {k: found[k] for k in FLAT}


#: Fixed value: the columns of a flattened result.
FLAT = ("title", "subject", "grade", "material_type", "language", "curriculum", "tags", "summary", "confidence", "needs_review")


def flat_rows(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, the columns of ``flattened``) of each row; every result is read once."""
    return rows.select(key, F.inline(F.array(_flat(F.col(json)))))


def _flat(json: Column) -> Column:
    """What ``flattened`` gives, as one struct."""
    let = json_map.let
    plain = lambda x: F.try_variant_get(x, "$", "string")
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    label = lambda x: F.coalesce(F.nullif(_texts(x, "$.zh"), F.lit("")), _texts(x, "$.en"))
    name = lambda x: F.when(is_object(x), label(x)).otherwise(plain(x))
    system = lambda x: F.when(is_object(x), F.coalesce(F.nullif(label(x), F.lit("")), plain(x))).otherwise(plain(x))
    lists = [("$.normalized_tags.topic_tags", name), ("$.normalized_tags.skill_tags", name), *((f"$.system_tags.{k}_tags", system) for k in ("format", "engine", "artifact"))]
    filled = lambda v, p: let(_texts(v, p), lambda t: F.when(t != "", t))
    zh = lambda v, f: F.coalesce(filled(v, f"$.controlled_classification.{f}.zh"), _texts(v, f"$.primary_facets.{f}.zh"), F.lit(""))
    facets = ("subject", "stage", "level", "resource_type", "component_role", "curriculum")

    def texts(v: Column) -> Column:
        said = {"series": "$.descriptive_metadata.series_title", "spoken": "$.descriptive_metadata.language", "sure": "$.governance.confidence"}
        return F.struct(*(zh(v, f).alias(f) for f in facets), *(F.coalesce(_texts(v, p), F.lit("")).alias(k) for k, p in said.items()))

    def shown(v: Column, t: Column) -> Column:
        summary = F.array_join(F.filter(F.array(*(t[f] for f in facets[:4])), lambda x: x != ""), " · ")
        asked = F.coalesce(F.try_variant_get(v, "$.governance.human_review_required", "boolean"), F.lit(False))
        tags = F.concat(*(F.transform(_list(v, p), n) for p, n in lists))
        made = lambda summary: {
            "title": text_or(t["series"], text_or(summary, t["subject"])),
            "subject": t["subject"], "grade": text_or(t["level"], t["stage"]), "material_type": text_or(t["resource_type"], t["component_role"]), "language": text_or(t["spoken"], "中文"), "curriculum": t["curriculum"],
            "tags": tags, "summary": summary,
            "confidence": F.when(t["sure"] == "high", 90).when(t["sure"] == "medium", 60).otherwise(30), "needs_review": asked | (t["sure"] != "high"),
        }
        return let(summary, lambda s: F.struct(*(c.alias(k) for k, c in made(s).items())))

    failed = {"title": F.lit(FAILED_TITLE), "subject": F.lit(""), "grade": F.lit("")}
    kinds = {"tags": "array<string>", "confidence": "int", "needs_review": "boolean"}
    without = F.struct(*(failed.get(k, F.lit(None).cast(kinds.get(k, "string"))).alias(k) for k in FLAT))
    some = lambda v: _counts(F.try_variant_get(v, "$.primary_facets", "variant")).isNotNull()
    return let(F.try_parse_json(json), lambda v: F.when(some(v), let(texts(v), lambda t: shown(v, t))).otherwise(without))


def source_facts(jobs: DataFrame, materials: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each job with the facts on its source, from its material's columns and metadata, its task's and its own, in the order in which they count."""
    m = materials.select(F.col("id").alias("material_id"), F.struct(*(c for c in materials.columns if c != "id")).alias("m"))
    t = tasks.select(F.col("id").alias("parse_task_id"), F.struct(*(c for c in tasks.columns if c != "id")).alias("t"))
    rows = jobs.join(m, "material_id", "left").join(t, "parse_task_id", "left")
    has = {"m": set(materials.columns), "t": set(tasks.columns)}

    def first(*places: str) -> Column:
        """``m.x`` is a column, ``m:x`` a path in the metadata."""
        found = []
        for p in places:
            table, path = p[0], p[2:]
            if p[1] == ":":
                c = F.get_json_object(f"{table}.metadata", f"$.{path}")
            elif table == "j" or path in has[table]:
                c = F.col(path if table == "j" else f"{table}.{path}").cast("string")
            else:
                continue
            found.append(F.when(~(blank(c) | (c == "0")), c))
        return F.coalesce(*found)

    facts = {
        "filename": F.coalesce(first("m.file_name", "m.title", "t:originalFilename", "t.original_filename"), F.lit("unknown")),
        "file_size": F.coalesce(first("m:fileSize", "m.file_size", "t:mineruExecutionProfile.fileSize", "t:fileSize", "t:originalFileSize", "t.original_file_size").try_cast("bigint"), F.lit(0)),
        "mime_type": F.coalesce(first("m.mime_type", "m:mimeType", "t:mimeType", "t.mime_type"), F.lit("")),
        "raw_object_name": F.coalesce(first("m:objectName", "t:objectName"), F.lit("")),
        "parsed_prefix": F.coalesce(first("t:parsedPrefix", "m:parsedPrefix"), F.lit("")),
        "markdown_object_name": F.coalesce(first("t:markdownObjectName", "m:markdownObjectName", "j.input_markdown_object_name"), F.lit("")),
        "parsed_files_count": F.coalesce(first("t:parsedFilesCount", "m:parsedFilesCount").try_cast("bigint"), F.lit(0)),
        "execution_profile": F.coalesce(first("t:mineruExecutionProfile", "m:mineruExecutionProfile"), F.lit("{}")),
    }
    return rows.select(F.col("id").alias("job_id"), "material_id", *(c.alias(k) for k, c in facts.items()))


def skeleton(reason: Column, parsed: Column, level: Column, source: dict[str, Column], versions: tuple[str, str] = ("unknown", "unknown"), tags: dict[str, Column] | None = None) -> Column:
    """The whole result that stands for a failed classification, as a struct.

    ``source`` has the facts on the file, ``versions`` those of the taxonomy and of its
    rules, ``tags`` the lists of system tags that are known. To write it as JSON keep
    null fields (``ignoreNullFields`` false): the controlled facets are null.
    Fixed values: the names of its parts and their contents.
    """
    failed = F.coalesce((level == "low") & (reason != ""), F.lit(False))
    got = fallback(reason, parsed)
    none = F.array().cast("array<string>")
    signals = F.concat(F.when(failed, F.concat(got["risk_flags"], F.array(F.lit("skeleton_fallback")))).otherwise(none), F.when(level == "low", F.array(F.lit("low_confidence"))).otherwise(none), F.array(F.lit("needs_human_review")), F.when(failed, none).otherwise(F.array(F.lit("evidence_missing"))))
    empty = lambda *names: F.struct(*(F.lit("").alias(n) for n in names))
    lists = lambda *names: F.struct(*(none.alias(n) for n in names))
    said = F.struct(F.lit("system").alias("type"), F.lit("AI provider failed; fallback skeleton generated").alias("quote_or_summary"), F.array(F.lit("human_review_required")).alias("supports"))
    system = F.struct(*((tags or {}).get(k, none).alias(k) for k in ("format_tags", "artifact_tags", "engine_tags")))
    return F.struct(
        F.lit(versions[0]).alias("taxonomy_version"), F.lit(versions[1]).alias("rules_version"),
        F.struct(*(c.alias(k) for k, c in source.items())).alias("source"),
        F.struct(*(empty("zh", "en").alias(f) for f in FACET_NAMES)).alias("primary_facets"),
        empty("series_title", "edition", "year", "publisher_org", "language").alias("descriptive_metadata"),
        lists("topic_tags", "skill_tags").alias("search_tags"),
        F.struct(*(F.lit(None).cast("string").alias(f) for f in FACET_NAMES)).alias("controlled_classification"),
        lists("topic_tags", "skill_tags").alias("normalized_tags"),
        none.alias("proposed_new_tags"),
        F.struct(F.lit(True).alias("required"), F.array(F.lit("skeleton_fallback")).alias("reasons"), F.from_json(F.lit("{}"), "map<string,string>").alias("unmatched_facets")).alias("classification_review"),
        F.struct(
            level.alias("confidence"), F.lit(True).alias("human_review_required"), F.coalesce(reason, F.lit("")).alias("human_review_reason"), F.lit("partial").alias("markdown_quality"), F.lit(False).alias("duplicate_candidate"),
            F.lit("keep_pending_review").alias("retention_policy"), F.when(failed, got["risk_flags"]).otherwise(none).alias("risk_flags"),
        ).alias("governance"),
        F.when(failed, F.array(said)).otherwise(F.array().cast("array<struct<type:string,quote_or_summary:string,supports:array<string>>>")).alias("evidence"),
        system.alias("system_tags"),
        F.struct(F.when(F.coalesce(parsed, F.lit(0)) == 0, F.array(F.lit("no_parsed_artifacts"))).otherwise(none).alias("quality"), none.alias("relationship"), none.alias("retention"), signals.alias("risk")).alias("governance_signals"),
        F.lit("").alias("recommended_catalog_path"), F.lit("needs_human_review").alias("catalog_change_type"),
    )
