"""Parse results of any shape, against the rules written out."""

import json
import random
import re

from pyspark.sql import functions as F

from quire.operators import semistructured

MD = ("md_content", "mdcontent", "mdContent", "md_text", "markdown", "text")


def clean(x):
    return x.strip(" \t\n\r\x0b\x0c 　﻿")


def get(x, *path):
    for k in path:
        x = x.get(k) if isinstance(x, dict) else None
    return x


def markdown(p):
    if isinstance(p, str):
        return clean(p)
    if not isinstance(p, dict | list):
        return ""
    r = get(p, "results")
    if isinstance(r, dict | list) and r:
        if isinstance(r, dict):
            numbers = sorted(int(k) for k in r if re.fullmatch("0|[1-9][0-9]*", k))
            first = r[str(numbers[0]) if numbers else next(iter(r))]
        else:
            first = r[0]
        md = next((v for v in (get(first, k) for k in MD[:3]) if v is not None), None)
        if isinstance(md, str) and clean(md):
            return clean(md)
    if isinstance(p, list):
        return clean(p[0]["text"]) if p and isinstance(get(p[0], "text"), str) else ""
    data = get(p, "data")
    listed = next((x for x in data if isinstance(x, str)), None) if isinstance(data, list) else None
    found = [get(p, k) for k in MD] + [get(data, k) for k in MD] + [get(p, "output", "md_text"), get(p, "output", "markdown"), listed]
    return next((clean(x) for x in found if isinstance(x, str) and clean(x)), "")


def artifacts(p):
    def items(x):
        return x if isinstance(x, list) else [x] if x else []

    def first(item, names):
        return next((item[n] for n in names if item.get(n)), None)

    def inner(rows):
        for r in rows if isinstance(rows, list) else []:
            a = get(r, "artifacts")
            yield from items(a if a or isinstance(a, list | dict) else get(r, "files"))

    every = [x for path in (("artifacts",), ("files",), ("data", "artifacts"), ("data", "files"), ("results", "artifacts"), ("results", "files")) for x in items(get(p, *path))]
    out = []
    for item in [*every, *inner(get(p, "results")), *inner(get(p, "data"))]:
        if not isinstance(item, dict):
            continue
        name = first(item, ("relativePath", "path", "name", "filename", "file_name"))
        if not isinstance(name, str) or not clean(name):
            continue
        data = first(item, ("base64", "content_base64", "data_base64", "contentBase64", "dataBase64"))
        url = first(item, ("url", "download_url", "downloadUrl", "presignedUrl"))
        kind = first(item, ("mimeType", "mimetype", "contentType", "Content-Type"))
        kind = (clean(kind if isinstance(kind, str) else json.dumps(kind)) if kind is not None else "") or None
        if isinstance(data, str) and clean(data):
            out.append((name, kind, "bytes", data))
        elif isinstance(url, str) and re.match("(?i)https?://", url):
            out.append((name, kind, "url", url))
    return out


def test_markdown(spark):
    rng = random.Random(1)
    value = lambda: rng.choice([None, "", " ", " x ", 5, "y", {"md_content": "deep"}, ["l"], False])
    some = lambda names: {k: value() for k in rng.sample(names, rng.randrange(len(names)))}
    cases = ['"a"', "[]", "null", "3", "{}"]
    for _ in range(300):
        p = some(list(MD))
        if rng.random() < 0.7:
            inner = lambda: rng.choice([None, "t", 1, some(list(MD[:3])), some(list(MD[:3])), {"md_content": "z"}])
            p["results"] = rng.choice([{rng.choice(["zeta", "b", "10", "2", "01", "a b", "é"]): inner() for _ in range(rng.randrange(4))}, [inner() for _ in range(rng.randrange(3))], "text", None])
        if rng.random() < 0.5:
            p["data"] = rng.choice([some(list(MD)), [value() for _ in range(3)]])
        if rng.random() < 0.3:
            p["output"] = some(["md_text", "markdown"])
        cases.append(json.dumps(rng.choice([p, p, p, [p, 1]]), ensure_ascii=rng.random() < 0.5))
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, j string")
    got = {r.i: r.m for r in df.select("i", semistructured.markdown_of(F.col("j")).alias("m")).collect()}
    assert [(c, got[i]) for i, c in enumerate(cases)] == [(c, markdown(json.loads(c))) for c in cases]


def test_artifacts(spark):
    rng = random.Random(2)
    value = lambda: rng.choice([None, "", " ", "v", 0, 7, False, True, "http://h/x", "ftp://x", "HTTPS://h"])
    names = ["relativePath", "path", "name", "file_name", "mimeType", "Content-Type", "base64", "dataBase64", "url", "presignedUrl"]
    item = lambda: rng.choice([{k: value() for k in rng.sample(names, 6)}, {"path": "p", "base64": "QQ=="}, None, "s", [{"path": "nested", "base64": "QQ=="}]])
    listed = lambda: rng.choice([[item() for _ in range(rng.randrange(3))], [], item(), "", 0])
    holder = lambda: {k: listed() for k in ("artifacts", "files") if rng.random() < 0.7}
    cases = [{**holder(), **{k: rng.choice([holder(), [rng.choice([holder(), None, 1]) for _ in range(3)]]) for k in ("data", "results") if rng.random() < 0.8}} for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, j string")
    got = {}
    for r in semistructured.artifacts_of(df, "i", "j").orderBy("i", "nth").collect():
        got.setdefault(r.i, []).append((r.path, r.media_type, r.source, r.content))
    for i, c in enumerate(cases):
        assert (c, got.get(i, [])) == (c, artifacts(c))


def test_flattened_results(spark):
    tags = {"normalized_tags": {"topic_tags": [1, "t", True, {"zh": "", "en": "e"}]}, "system_tags": {"format_tags": [{"en": "x"}, {"other": 1}, "pdf"]}}
    cases = [{}, {"primary_facets": None, **tags}, {"primary_facets": "", **tags}, {"primary_facets": {}, **tags}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, j string")
    rows = df.select("i", *(c.alias(k) for k, c in semistructured.flattened(F.col("j")).items())).orderBy("i").collect()
    for r in rows[:3]:
        assert (r.title, r.subject, r.grade) == ("解析失败", "", "") and r.tags is None and r.confidence is None and r.needs_review is None
    assert (rows[3].title, rows[3].tags, rows[3].confidence, rows[3].needs_review) == ("", ["1", "t", "true", "e", "x", '{"other":1}', "pdf"], 30, True)


def test_whole_skeleton(spark):
    """Every part of the result that stands for a failed one."""
    facts = {"material_id": F.lit("7"), "file_name": F.lit("a.pdf"), "file_size": F.lit(0)}
    made = semistructured.skeleton(F.lit("json_parse_failed"), F.lit(0), F.lit("low"), facts, ("v0.1", "r2"), {"format_tags": F.array(F.lit("pdf"))})
    got = json.loads(spark.range(1).select(F.to_json(made, {"ignoreNullFields": "false"}).alias("j")).first().j)
    names = ("domain", "collection", "curriculum", "stage", "level", "subject", "resource_type", "component_role")
    flags = ["skeleton_fallback", "ai_provider_json_parse_failed"]
    assert got == {
        "taxonomy_version": "v0.1", "rules_version": "r2", "source": {"material_id": "7", "file_name": "a.pdf", "file_size": 0}, "primary_facets": {n: {"zh": "", "en": ""} for n in names},
        "descriptive_metadata": {"series_title": "", "edition": "", "year": "", "publisher_org": "", "language": ""}, "search_tags": {"topic_tags": [], "skill_tags": []}, "controlled_classification": dict.fromkeys(names),
        "normalized_tags": {"topic_tags": [], "skill_tags": []}, "proposed_new_tags": [], "classification_review": {"required": True, "reasons": ["skeleton_fallback"], "unmatched_facets": {}},
        "governance": {"confidence": "low", "human_review_required": True, "human_review_reason": "json_parse_failed", "markdown_quality": "partial", "duplicate_candidate": False, "retention_policy": "keep_pending_review", "risk_flags": flags},
        "evidence": [{"type": "system", "quote_or_summary": "AI provider failed; fallback skeleton generated", "supports": ["human_review_required"]}], "system_tags": {"format_tags": ["pdf"], "artifact_tags": [], "engine_tags": []},
        "governance_signals": {"quality": ["no_parsed_artifacts"], "relationship": [], "retention": [], "risk": [*flags, "skeleton_fallback", "low_confidence", "needs_human_review"]}, "recommended_catalog_path": "", "catalog_change_type": "needs_human_review",
    }
