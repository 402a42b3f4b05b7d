"""Document text: outlines, samples, evidence packs, file names, formats. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import blank, text_or

#: Types by extension and by media type.
CONTENT_TYPES = {
    "md": "text/markdown; charset=utf-8", "json": "application/json; charset=utf-8", "txt": "text/plain; charset=utf-8", "html": "text/html; charset=utf-8", "css": "text/css; charset=utf-8",
    "js": "application/javascript; charset=utf-8", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "pdf": "application/pdf", "zip": "application/zip", "xml": "application/xml; charset=utf-8",
}
FORMATS = {
    "PDF": ("application/pdf", ("pdf",)), "JPG": ("image/jpeg", ("jpg", "jpeg")), "PNG": ("image/png", ("png",)), "DOC": ("application/msword", ("doc",)),
    "DOCX": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ("docx",)), "PPT": ("application/vnd.ms-powerpoint", ("ppt",)),
    "PPTX": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", ("pptx",)),
}
HEADING = r"^(#{1,6}|\d+\.)\s+(.+)"
TOC_START = "(?i)(目录|TOC|Table of Contents|CONTENTS)"
CUT_MARK = "\n\n...[内容已截断]...\n\n"
PACK_LIMIT = 30_000
SAMPLE_LIMIT = 80_000
#: Beyond one of these a document is large: characters, parsed files.
LARGE_CHARS, LARGE_FILES = 150_000, 1000
PACK_SUFFIX = "\\n...[Evidence Pack Truncated]"


def piece(text: Column, start: Column, length: Column | int) -> Column:
    """``length`` characters from a zero-based start."""
    return F.substr(text, (start + 1).cast("int"), length.cast("int") if isinstance(length, Column) else F.lit(length))


def headings(text: Column, most: int = 120, width: int = 200) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.slice(F.transform(F.filter(lines, lambda x: x.rlike(HEADING)), lambda x: F.left(x, F.lit(width))), 1, most)


def toc(text: Column) -> Column:
    """The contents block: its heading and 100 to 2000 further characters, 2000 in all at most."""
    found = F.regexp_extract(text, r"(?is)((?:contents|table of contents|目录).{100,2000})", 1)
    return text_or(F.left(found, F.lit(2000)), "not_found")


def snippet(text: Column, share: float, length: int = 1500) -> Column:
    return F.trim(piece(text, F.floor(F.length(text) * F.lit(share)), length), F.lit(" \n\t\r"))


def tail(text: Column) -> Column:
    return F.when(F.length(text) < 5000, F.right(text, F.lit(1000))).otherwise(F.right(text, F.lit(3000)))


def name_tokens(name: Column) -> Column:
    """Parts of a file name of more than two characters, without a known extension."""
    clean = F.regexp_replace(name, r"(?i)\.(pdf|docx?|zip|pptx?|epub)$", "")
    return F.filter(F.split(clean, r"[_\-()\[\]\s]+"), lambda t: F.length(t) > 2)


def pack_text(text: Column, name: Column, limit: int = PACK_LIMIT) -> Column:
    """Front matter, outline, contents, snippets and tail of a long text under one cap."""
    outline, signals, block = headings(text), F.array_join(name_tokens(name), " | "), toc(text)
    parts = [
        ("FILENAME SIGNALS", signals),
        ("DOCUMENT SHAPE", F.concat(F.lit("markdown_chars: "), F.length(text).cast("string"), F.lit("\nheading_count: "), F.size(outline).cast("string"), F.lit("\ntoc_detected: "), (block != "not_found").cast("string"))),
        ("TITLE / FRONT MATTER", F.left(text, F.lit(3000))), ("TOC / CONTENTS", block), ("HEADING OUTLINE", F.array_join(outline, "\n")),
        ("EARLY BODY", snippet(text, 0.1)), ("MIDDLE CHAPTER", snippet(text, 0.5)), ("LATE CHAPTER", snippet(text, 0.8)), ("TAIL", tail(text)),
    ]
    pack = F.concat(*[x for title, body in parts for x in (F.lit(f"=== {title} ===\n"), body, F.lit("\n\n"))])
    return F.when(F.length(pack) > limit, F.concat(F.left(pack, F.lit(limit)), F.lit(PACK_SUFFIX))).otherwise(pack)


#: The facts at the head of a whole pack, and its sections in order.
FACTS = ("file_name", "file_size", "mime_type", "parsed_files_count", "raw_object_name", "markdown_object_name")
SECTIONS = ("SOURCE FACTS", "FILENAME SIGNALS", "DOCUMENT SHAPE", "TITLE / FRONT MATTER", "TOC / CONTENTS", "HEADING OUTLINE", "REPRESENTATIVE BODY SNIPPETS", "TAIL / APPENDIX / ANSWER SIGNALS", "EVIDENCE CANDIDATES")


def whole_pack(text: Column, facts: dict[str, Column], limit: int = PACK_LIMIT) -> Column:
    """The evidence pack with all sections, of a text and the ``FACTS`` on its source; blank names give empty lines, a missing size or count is 0."""
    numbers = ("file_size", "parsed_files_count")
    known = {k: F.coalesce(facts[k].cast("string"), F.lit("0" if k in numbers else "")) for k in FACTS}
    name = text_or(known["file_name"], known["raw_object_name"])
    outline, signals, block = headings(text), F.array_join(name_tokens(name), " | "), toc(text)
    n, files = F.length(text), known["parsed_files_count"]
    said = lambda label, value: F.concat(F.lit(f"{label}: "), value.cast("string"))
    lines = lambda *parts: F.concat_ws("\n", *parts)
    large = (n > LARGE_CHARS) | F.coalesce(files.try_cast("bigint") > LARGE_FILES, F.lit(False))
    bodies = (
        lines(*(said(k, name if k == "file_name" else known[k]) for k in FACTS)), signals,
        lines(said("markdown_chars", n), said("estimated_pages", files), said("large_document", large), said("heading_count", F.size(outline)), said("toc_detected", block != "not_found")),
        F.left(text, F.lit(3000)), block, F.array_join(outline, "\n"),
        lines(F.lit("--- EARLY BODY ---"), snippet(text, 0.1), F.lit("\n--- MIDDLE CHAPTER ---"), snippet(text, 0.5), F.lit("\n--- LATE CHAPTER ---"), snippet(text, 0.8)), tail(text), signals,
    )
    pack = F.concat(F.concat_ws("\n\n", *(lines(F.lit(f"=== {title} ==="), body) for title, body in zip(SECTIONS, bodies, strict=True))), F.lit("\n"))
    return F.when(F.length(pack) > limit, F.concat(F.left(pack, F.lit(limit)), F.lit(PACK_SUFFIX))).otherwise(pack)


def evidence_pack(text: Column, name: Column, limit: int = PACK_LIMIT) -> dict[str, Column]:
    """Length and fingerprint of ``pack_text``."""
    pack = pack_text(text, name, limit)
    return {"pack_chars": F.length(pack), "input_hash": F.concat(F.lit("sha256:"), F.sha2(pack, 256))}


def sample(text: Column, header: Column, limit: int = SAMPLE_LIMIT) -> Column:
    """Header and, if the text does not fit, its head, contents, middle and tail."""
    room = F.lit(limit) - F.length(header) - 150
    n = F.length(text)
    part = lambda share: F.floor(room * F.lit(share))
    head, end, contents = part(0.2), part(0.1), part(0.1)
    middle = room - head - end - contents
    at = F.regexp_instr(text, F.lit(TOC_START)) - 1
    near = F.greatest(F.lit(0), at - F.floor(contents / 4))
    block = F.when(at >= 0, piece(text, near, F.least(n, at + F.floor(contents * 0.75)) - near)).otherwise(piece(text, F.floor(n * F.lit(0.1)), contents))
    centre = F.floor(n / 2 - middle / 2)
    pieces = ["=== HEAD ===", F.left(text, head.cast("int")), "\n=== TOC/NEAR HEAD ===", block, "\n=== MIDDLE ===", piece(text, centre, middle), "\n=== TAIL ===", F.right(text, end.cast("int")), "\n=== ARTIFACT SIGNAL ===\n[sampled representation]"]
    whole = F.concat_ws("\n", header, *[p if isinstance(p, Column) else F.lit(p) for p in pieces])
    return F.when(blank(text), "").when(room <= 0, header).when(n <= room, F.concat(header, text)).otherwise(whole)


def model_input(text: Column, name: Column, header: Column, files: Column) -> dict[str, Column]:
    """Mode, content and whether it is cut: the evidence pack of a large document, else its sample."""
    text = F.coalesce(text, F.lit(""))
    large = (F.length(text) > LARGE_CHARS) | (F.coalesce(files, F.lit(0)) > LARGE_FILES)
    content = F.when(large, pack_text(text, name)).otherwise(sample(text, header))
    return {"mode": F.when(large, "evidence-pack-v0.3").otherwise("legacy-sampler-v0.2"), "content": content, "truncated": large | (F.length(text) > F.length(content))}


def context(text: Column, limit: int) -> Column:
    """Head and tail around a marker; limits are kept between 10,000 and 200,000."""
    limit = max(10_000, min(200_000, limit))
    head = limit * 6 // 10
    cut = F.concat(F.left(text, F.lit(head)), F.lit(CUT_MARK), F.right(text, F.lit(max(0, limit - head - len(CUT_MARK)))))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?(?:</think>|$)", ""), F.lit(" \n\t\r"))


def looks_truncated(text: Column) -> Column:
    """Opens an object but ends in neither bracket."""
    end = F.right(F.trim(text, F.lit(" \n\t\r")), F.lit(1))
    return text.contains("{") & ~end.isin("}", "]")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def file_format(mime: Column, name: Column) -> Column:
    low, ext = F.lower(F.coalesce(mime, F.lit(""))), extension(F.coalesce(name, F.lit("")))
    out = F.when(F.lit(False), "")
    for label, (media, extensions) in FORMATS.items():
        out = out.when((low == media) | ext.isin(*extensions), label)
    return out.when(ext != "", F.upper(ext)).otherwise("未知")


def content_type(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for ext, media in CONTENT_TYPES.items():
        out = out.when(F.lower(name).endswith("." + ext), media)
    return out.otherwise("application/octet-stream")


def safe_path(path: Column) -> Column:
    """Slashes unified, empty and dot parts dropped; a path that climbs is refused whole."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "^/+", ""))
    parts = F.filter(F.split(clean, "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.exists(parts, lambda p: p == ".."), "").otherwise(F.array_join(parts, "/"))


def safe_name(name: Column) -> Column:
    """Reserved characters and white space replaced; leading and trailing underscores gone."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"|?*\\/\x00-\x1F]', "_"), r"\s+", "_")
    return text_or(F.regexp_replace(clean, r"^_+|_+$", ""), "upload.bin")


def repaired_name(name: Column) -> Column:
    """UTF-8 that was read as Latin-1, put right where that yields Chinese characters."""
    latin = name.rlike(r"^[\x{00}-\x{FF}]*$") & name.rlike(r"[\x{80}-\x{FF}]")
    fixed = F.decode(F.encode(F.when(latin, name), "ISO-8859-1"), "UTF-8")
    fixed = F.when(F.is_valid_utf8(F.encode(F.when(latin, name), "ISO-8859-1").cast("string")), fixed)
    return F.when(fixed.rlike(r"[\x{4E00}-\x{9FFF}]"), fixed).otherwise(name)


def bytes_text(n: Column) -> Column:
    one = lambda x: F.format_string("%.1f", F.round(x, 1))
    return (
        F.when(n.isNull() | (n <= 0), "0 B").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(one(n / 1024), F.lit(" KB")))
        .when(n < 1024**3, F.concat(one(n / 1024**2), F.lit(" MB"))).otherwise(F.concat(one(n / 1024**3), F.lit(" GB")))
    )


def duration_text(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    m, h = F.floor(s / 60), F.floor(s / 3600)
    text = lambda *x: F.concat(*(y.cast("string") if isinstance(y, Column) else F.lit(y) for y in x))
    return F.when(ms.isNull() | (ms <= 0), "0s").when(s < 60, text(s, "s")).when(m < 60, text(m, "m ", s % 60, "s")).otherwise(text(h, "h ", m % 60, "m"))


def timeout_ms(value: Column) -> Column:
    """Values up to 3600 mean seconds."""
    return F.when(value <= 3600, value * 1000).otherwise(value)


def confidence(label: Column) -> Column:
    return F.when(label == "high", 90).when(label == "medium", 60).otherwise(30)


def url_expiry(url: Column) -> Column:
    """When a signed address expires, in seconds since 1970; null where it does not say."""
    part = lambda name: F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
    return F.unix_timestamp(F.try_to_timestamp(part("X-Amz-Date"), F.lit("yyyyMMdd'T'HHmmss'Z'"))) + part("X-Amz-Expires").try_cast("bigint")
