"""Secret scan by assignment-aware lexing.

Three fixed patterns give the base findings. Beyond them a lexer reads
name-literal pairs of source and configuration syntax (``name = "literal"``,
``name: literal``, ``"name": "literal"``, ``name := other_name``, with a type, a
subscript (``env["name"] = "literal"``), chained, in lists (``a, name = "x",
"literal"``) or with a default (``get() or "literal"``); literals in single, double,
triple quotes or backticks, with a prefix or as the argument of a call that gives
them back, or without quotes up to the next white space; passwords in URLs; ``<name>text</name>``, attributes
``key="name" value="literal"``, arguments ``"name", "literal"``, calls
``set_name("literal")``, CDATA, here-documents and YAML blocks), joins literals concatenated by ``+``,
propagates constants to the names that refer to them, and scores every literal by
the most sensitive name it ends up in and how much it looks like key material.
Literals at ``THRESHOLD`` or more that no base finding covers are added as kind
``named``. Neither names nor literals have a longest length.

Defined results: a null text is empty; offsets count code points, ends are
exclusive; rows that share a doc_id are scanned each for itself. Extra columns
are ignored. The order of definitions does not matter; every literal that a name
is given counts for the names that refer to it. Pairs inside a literal are read
too. A quote that is not closed opens no literal.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textblocks as tb

KINDS = ("assign", "access", "hex", "named")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of 32 characters or more

THRESHOLD = 0.5
#: Possessive, as a character that ends a part never begins the next: no backtracking, whatever the length.
_LITERAL_FORM = r"""(?:\"{3}(?:[^"\\]++|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]++|\\[\s\S]|'(?!''))*+'{3}|"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+'|`(?:[^`\\]++|\\[\s\S])*+`)"""
_LITERAL = re.compile(_LITERAL_FORM)
_NAME_FORM = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: An assignment up to its sign: a name, perhaps with a subscript, which then is the name, or with a type.
_TARGET = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>{_NAME_FORM})(?:\[[\ \t]*+(?P<q>["'])(?P<key>{_NAME_FORM})(?P=q)[\ \t]*+\])?["']?[\ \t]*+
        (?:(?::[\ \t]*+[A-Za-z_][A-Za-z0-9_.\[\],|?\ \t]*+=(?![=>])|:=|=>|\?\?=|\?=|\|\|=|\+=|=(?!=)|:(?!:)))""",
    re.VERBOSE,
)
_GAP = re.compile(r"[ \t]*+")
_PREFIXED = re.compile(rf"(?:(?<![A-Za-z0-9_])[fFbBrRuU]{{1,2}}+(?=[\"'`]))?(?P<literal>{_LITERAL_FORM})")
_CALLED = re.compile(rf"(?:new[\ \t]++)?(?P<name>{_NAME_FORM})[\ \t]*+\((?P<gap>[\ \t\n]*+)")
_REST_OF_CALL = re.compile(rf"""(?:[^()"'`\n]++|{_LITERAL_FORM})*+\)""")
_JOIN = re.compile(r"[ \t]*+(?P<sign>\+(?!=)|\|\||\?\?|or\b)[ \t\n]*+")
_COMMA = re.compile(r"[ \t]*+,")
_REFERENCE = re.compile(rf"{_NAME_FORM}(?![A-Za-z0-9+/=])")
_CHAIN = re.compile(rf"{_NAME_FORM}[\ \t]++=(?!=)")
#: A value without quotes ends at white space, or where a list of pairs goes on; within a line also at what closes or separates.
_NEXT_PAIR = r"(?![,;&][A-Za-z_][A-Za-z0-9_.\-]*+[=:])"
_WHOLE_RUN, _RUN = re.compile(rf"(?:{_NEXT_PAIR}\S)++"), re.compile(rf"""(?:{_NEXT_PAIR}[^\s,;&()\[\]{{}}<>"'`])++""")
_LINE_BEGIN = re.compile(r"""(?:^|\n)[ \t]*+(?:(?:export|set|setx|ENV|ARG|-)[ \t]++)?["']?$""")
#: Calls whose argument is what they give.
_GIVES = {"format", "bytes", "str", "string", "decode", "encode", "b64decode", "base64decode", "fromhex", "unhexlify", "atob", "btoa", "from", "valueof", "strip", "trim", "tochararray", "getbytes"}
#: Members of something: names and never secrets.
_MEMBER = re.compile(r"^(?:[A-Za-z_][A-Za-z_]*+\.)+[A-Za-z_][A-Za-z_]*+(?:\(\)?)?$")
_URL = re.compile(r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]{1,30}+://[^\s:@/]*+:(?P<value>[^\s@/]++)@")
_CDATA = re.compile(rf"<(?P<name>{_NAME_FORM})(?:[\ \t\n][^<>]*+)?>[\ \t\n]*+<!\[CDATA\[")
#: Pairs that need no assignment sign: their name and their one literal.
_CALL = re.compile(rf"(?<![A-Za-z0-9_.\-])(?P<name>{_NAME_FORM})\([\ \t\n]*+(?P<value>{_LITERAL_FORM})[\ \t\n]*+\)")
_ARGUMENTS = re.compile(rf"""(?P<q>["'])(?P<name>{_NAME_FORM})(?P=q)[\ \t\n]*+,[\ \t\n]*+(?P<value>{_LITERAL_FORM})""")
_ATTRIBUTES = re.compile(rf"""(?<![A-Za-z0-9_.\-])(?:name|key|id)[\ \t]*+=[\ \t]*+(?P<q>["'])(?P<name>{_NAME_FORM})(?P=q)[\ \t\n]++value[\ \t]*+=[\ \t]*+(?P<value>{_LITERAL_FORM})""")
_ELEMENT = re.compile(rf"<(?P<name>{_NAME_FORM})(?:[\ \t\n][^<>]*+)?>(?P<value>[^<>]++)</(?P=name)[\ \t\n]*+>")
_OPENED, _NEXT, _VALUE = re.compile(r"\([ \t\n]*+[\"'`]"), re.compile(r"[\"'][ \t\n]*+,"), re.compile(r"value[ \t]*+=")
#: Where a here-document or a YAML block begins; its lines follow.
_HEREDOC = re.compile(rf"(?<![A-Za-z0-9_.\-])(?P<name>{_NAME_FORM})[\ \t]*+(?:=|:=|:)[\ \t]*+(?:[\"']?\$\([\ \t]*+cat[\ \t]*+)?<<<?[\ \t]*+[-~]?[\"']?(?P<mark>[A-Za-z_][A-Za-z0-9_]*+)[\"']?[^\n]*+\n")
_LONE_WORD = re.compile(r"^[\ \t]*+([A-Za-z_][A-Za-z0-9_]*+)[;),\"'\ \t\r]*+$", re.MULTILINE)
_BLOCK = re.compile(rf"^(?P<indent>[\ ]*+)(?:-[\ ]++)?[\"']?(?P<name>{_NAME_FORM})[\"']?:[\ \t]*+[|>][-+0-9]*+[\ \t\r]*+\n", re.MULTILINE)
_BLOCK_LINE = re.compile(r"([\ ]*+)[^\n]*+(?:\n|$)")
#: What a call that stores its argument begins with.
SETTERS = {"set", "with", "use", "put", "add", "define", "export", "init", "login", "auth", "authenticate"}
_PEM_MARK = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]{1,40}-----")
_LINE_END = re.compile(r"\\?\n[\ \t]*")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: How sensitive a word in a name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 1.0, "credentials": 1.0,
    "bearer": 0.9, "auth": 0.7, "authorization": 0.9, "signature": 0.6, "salt": 0.6, "session": 0.5, "cookie": 0.5, "key": 0.5, "pin": 0.5,
}
#: The sensitive words that hold no shorter one: a text without any of them has no sensitive name.
_SEEDS = [w for w in SENSITIVE if not any(v in w for v in SENSITIVE if v != w)]
#: Words that make a key sensitive.
_KEY_WORDS = {"api", "access", "private", "signing", "encryption", "master", "account", "client", "shared", "service"}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|changeme|change_me|example.*|your[_-].*|todo|none|null|true|false|redacted|placeholder|test|dummy|https?[:/].*)$|^\$\{.*\}$|^<.*>$|^%.*%$")


def name_score(name: str) -> float:
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    score = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    return 1.0 if "key" in parts and _KEY_WORDS.intersection(parts) else score


def literal_score(text: str) -> float:
    if "-----" in text or "\n" in text:  # key material over several lines
        text = _LINE_END.sub("", _PEM_MARK.sub("", text)).strip()
    if len(text) < 8 or _PLACEHOLDER.match(text) or " " in text:
        return 0.0
    n = len(text)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    kinds = sum(any(f(c) for c in text) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in text)
    return min(1.0, entropy / 4) * (0.4 if kinds == 1 else 0.8 if kinds == 2 else 1.0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _stores(name: str) -> bool:
    """Whether a call of this name keeps its argument: ``set_pwd``, ``withToken``, ``Password``; not ``get_token``."""
    parts = [p.lower() for p in _NAME_PART.findall(name.rsplit(".", 1)[-1])]
    return bool(parts) and (parts[0] in SETTERS or all(p in SENSITIVE or p in _KEY_WORDS for p in parts))


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    return s, e


def _blocks(text: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of the lines that here-documents and YAML blocks give to names."""
    found = []
    if "<<" in text:
        lone: dict[str, list[int]] = {}
        opened = list(_HEREDOC.finditer(text))
        if opened:
            for m in _LONE_WORD.finditer(text):
                lone.setdefault(m[1], []).append(m.start())
        for m in opened:
            places = lone.get(m["mark"], [])
            at = bisect_left(places, m.end())
            if at < len(places):
                found.append((m["name"], m.end(), places[at]))
    at = 0
    while "|" in text or ">" in text:
        m = _BLOCK.search(text, at)
        if not m:
            break
        at = e = m.end()
        while (line := _BLOCK_LINE.match(text, e)) and line.end() > e and (len(line[1]) > len(m["indent"]) or not line[0].strip()):
            e = line.end()
        if e > at:
            found.append((m["name"], at, e))
            at = e
    return found


@dataclass
class Pair:
    """A name and what it is given: literals (each a list of parts that are joined), names of others, and a value without quotes, which is one or the other."""

    name: str
    literals: list[list[tuple[int, int]]]
    others: list[str] = field(default_factory=list)
    bare: tuple[int, int] | None = None


def _inside(text: str, s: int, e: int) -> tuple[int, int]:
    """A literal without its quotes."""
    edge = 3 if e - s >= 6 and text[s : s + 3] in ('"""', "'''") else 1
    return s + edge, e - edge


def _bare(text: str, at: int, begins: bool, tight: bool) -> tuple[int, int]:
    """The value without quotes at a place; ``begins`` if its name begins the line, ``tight`` if nothing stands between sign and value."""
    m = (_WHOLE_RUN if begins and tight else _RUN).match(text, at)
    if not m:
        return at, at
    end = m.end()
    while end > at and text[end - 1] in (",;" if begins and tight else ".,;:!?"):
        end -= 1
    return at, end


def _expression(text: str, at: int, begins: bool, tight: bool, listed: bool) -> tuple[list[Pair], int, bool]:
    """The values from a place on, as pairs without a name (several if ``listed``), where the first operand begins, and whether it is a literal."""
    groups, first, quoted, fresh = [Pair("", [])], None, False, True
    while True:
        at = _GAP.match(text, at).end()
        here = groups[-1]
        if m := _PREFIXED.match(text, at):
            if fresh:
                here.literals.append([])
            here.literals[-1].append(_inside(text, *m.span("literal")))
            if first is None:
                first, quoted = m.start("literal"), True
            at = m.end()
        elif m := _CALLED.match(text, at):
            first = at if first is None else first
            at = m.end()
            if m["name"].rsplit(".", 1)[-1].lower() in _GIVES and (k := _PREFIXED.match(text, at)):
                here.literals.append([_inside(text, *k.span("literal"))])
            rest = _REST_OF_CALL.match(text, at)
            if not rest:
                break
            at = rest.end()
        elif first is None:
            first = at
            s, e = _bare(text, at, begins, tight)
            here.bare = (s, e) if e > s else None
            at = max(e, at)
            if e == s:
                break
        elif m := _REFERENCE.match(text, at):
            here.others.append(m[0])
            at = m.end()
        else:
            break
        if m := _JOIN.match(text, at):
            fresh = m["sign"] != "+" or not here.literals
            at = m.end()
        elif listed and (m := _COMMA.match(text, at)):
            groups.append(Pair("", []))
            at, fresh = m.end(), True
        else:
            break
    return groups, len(text) if first is None else first, quoted


def _cdata(text: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of the texts that elements mark as plain; one that is opened again before it ends is none."""
    ends = [m.start() for m in re.finditer(r"\]\]>", text)]
    opened = list(_CDATA.finditer(text))
    found = []
    for m, after in itertools.zip_longest(opened, opened[1:]):
        k = bisect_left(ends, m.end())
        if k < len(ends) and (after is None or ends[k] <= after.start()):
            found.append((m["name"], m.end(), ends[k]))
    return found


def _names_before(text: str, at: int, n: int) -> list[str]:
    """Up to ``n`` names that end before a place, each followed by a comma, the last first."""
    found = []
    while len(found) < n:
        k = at
        while k and text[k - 1] in " \t":
            k -= 1
        if not k or text[k - 1] != ",":
            break
        e = k - 1
        while e and text[e - 1] in " \t":
            e -= 1
        b = e
        while b and (text[b - 1].isalnum() or text[b - 1] in "_.-") and text[b - 1].isascii():
            b -= 1
        if b == e or text[b].isdigit():
            break
        found.append(text[b:e])
        at = b
    return found


def _pairs(text: str) -> list[Pair]:
    """All names with what they are given; pairs inside a literal are pairs as well."""
    found, at = [], 0
    assigns = "=" in text or ":" in text
    while assigns and (m := _TARGET.search(text, at)):
        place = m.start("name")
        begins = bool(_LINE_BEGIN.search(text, max(0, place - 40), place)) if place else True
        listed = text[max(0, place - 40) : place].rstrip(" \t").endswith(",")
        tight = m.end() < len(text) and text[m.end()] not in " \t" and m[0].endswith("=")
        groups, first, quoted = _expression(text, m.end(), begins, tight, listed)
        names = [m["key"] or m["name"]]
        if len(groups) > 1:
            names = [*reversed(_names_before(text, place, len(groups) - 1)), *names]
        if len(names) != len(groups):
            names, groups = names[-1:], groups[:1]
        for name, pair in zip(names, groups, strict=True):
            pair.name = name
            found.append(pair)
        # literals are read inside as well, and a chain of names goes on with the next
        bare = groups[0].bare
        at = max(m.end(), first + 1 if quoted else first if bare is None or _CHAIN.match(text, first) else bare[1])
    for form, sign in ((_CALL, _OPENED), (_ARGUMENTS, _NEXT), (_ATTRIBUTES, _VALUE)):
        if sign.search(text):
            found += [Pair(m["name"], [[_inside(text, *m.span("value"))]]) for m in form.finditer(text) if form is not _CALL or _stores(m["name"])]
    raw = _blocks(text) if assigns else []
    if "</" in text:
        raw += [(m["name"], *m.span("value")) for m in _ELEMENT.finditer(text)]
    if "<![CDATA[" in text:
        raw += _cdata(text)
    if "://" in text:
        raw += [("password", *m.span("value")) for m in _URL.finditer(text)]
    return found + [Pair(n, [[_trimmed(text, s, e)]]) for n, s, e in raw]


def _reached(starts, steps: dict[str, set[str]], seen: set[str]) -> list[str]:
    """What ``starts`` lead to, themselves included, besides ``seen``, which takes it in."""
    new, todo = [], list(starts)
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            new.append(n)
            todo.extend(steps.get(n, ()))
    return new


def named_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals that sensitive names receive, directly or through constants."""
    low = text.lower()
    if not any(w in low for w in _SEEDS) and not ("://" in low and _URL.search(text)):
        return []
    pairs = _pairs(text)
    scores = {n: name_score(n) for n in {p.name for p in pairs}}
    if not any(scores.values()):
        return []
    known = lambda name: name if name in scores else name.rsplit(".", 1)[-1]  # noqa: E731  a member goes by its own name
    # bare values that name something with a literal are references
    gives: dict[str, set[str]] = {}
    literal = set()
    for p in pairs:
        for other in [*p.others, *([text[slice(*p.bare)]] if p.bare else [])]:
            if (value := known(other)) in scores and value != p.name:
                gives.setdefault(value, set()).add(p.name)
        if p.literals or p.bare and known(text[slice(*p.bare)]) not in scores:
            literal.add(p.name)
    grounded: set[str] = set()
    _reached(literal, gives, grounded)
    takes: dict[str, set[str]] = {}
    for value in gives.keys() & grounded:
        for name in gives[value]:
            takes.setdefault(name, set()).add(value)
    # a constant is as sensitive as the most sensitive name that it ends up in
    seen: set[str] = set()
    for name, score in sorted(scores.items(), key=lambda x: -x[1]):
        for n in _reached([name], takes, seen):
            scores[n] = score
    found = set()
    for p in pairs:
        if scores[p.name] < THRESHOLD:
            continue
        values = list(p.literals)
        if p.bare and known(text[slice(*p.bare)]) not in takes.get(p.name, ()) and not _MEMBER.match(text[slice(*p.bare)]):
            values.append([p.bare])
        for parts in values:
            if scores[p.name] * literal_score("".join(text[i:j] for i, j in parts)) >= THRESHOLD:
                found.update((i, 3, j) for i, j in parts if j > i)
    return sorted(found)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base findings, and these with the additional ones, by start and kind."""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, _, e in base), max))  # the furthest end of the first ones
    covered = lambda s, e: (i := bisect_right(starts, s)) > 0 and reach[i - 1] >= e
    extra = [x for x in named_spans(text) if not covered(x[0], x[2])]
    return base, sorted([*base, *extra])


def show(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redact(text: str, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for s, _, e in found:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def _scan(with_text: bool):
    def run(batches):
        for batch in batches:
            for part, _, _ in tb.slices(batch, "text"):
                rows = []
                for t in part.column("text").to_pylist():
                    base, both = spans(t or "")
                    n = Counter(k for _, k, _ in base)
                    rows.append((n[0], n[1], n[2], hashlib.sha256(show(base).encode()).hexdigest(), show(both), redact(t, both) if with_text and t is not None else None))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3:]]
                names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]
                if not with_text:
                    arrays, names = arrays[:5], names[:5]
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], [*kept, *names])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans[, redacted]; no shuffle."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * redacted
    return texts.mapInArrow(_scan(redacted), schema).withColumnRenamed("id", id_col)


def cleaned(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced, all columns kept; ``length_col`` follows the text."""
    columns = docs.columns
    numbered = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns) if c != text_col), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "text")
    done = numbered.mapInArrow(_scan(True), fields + ", n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
    pick = []
    for i, c in enumerate(columns):
        if c == text_col:
            pick.append(F.col("redacted").alias(c))
        elif c == length_col:
            pick.append(F.when(F.col("spans") == "", F.col(f"c{i}")).otherwise(F.char_length("redacted")).cast(docs.schema[c].dataType).alias(c))
        else:
            pick.append(F.col(f"c{i}").alias(c))
    return done.select(*pick)
