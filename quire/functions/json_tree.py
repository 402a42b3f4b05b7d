"""Open JSON of any depth: redaction as a small Arrow-batched helper, the check of keys as expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a sensitive key, and the keys no record may carry.
SENSITIVE_KEY = re.compile("apiKey|accessKey|secretKey|token|authorization", re.IGNORECASE)
DANGEROUS_KEYS = frozenset(("__proto__", "constructor", "prototype"))
DEPTH = 20


def _redact(v):
    if isinstance(v, list):
        return [_redact(x) for x in v]
    if isinstance(v, dict):
        return {k: "<redacted>" if SENSITIVE_KEY.search(k) else _redact(x) for k, x in v.items()}
    return v


def _parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def _redacted(texts: pd.Series) -> pd.Series:
    found = (_parsed(t) for t in texts)
    return pd.Series([None if v is None else json.dumps(_redact(v), ensure_ascii=False, separators=(",", ":")) for v in found], dtype=object)


def redacted(c: Column | str) -> Column:
    """JSON with the values of sensitive keys replaced; null where the text is no JSON."""
    return F.pandas_udf(_redacted, "string")(c)


#: Every text of a JSON, and those of them that are keys: a colon follows only a key.
_TEXTS, _KEY = r'"(?:[^"\\]|\\.)*"(?:\s*:)?', r'^"(.*)"\s*:$'


def _inner(v: Column) -> Column:
    """The values in an object or a list."""
    kind = F.schema_of_variant(v)
    none = F.from_json(F.lit("[]"), "array<variant>")
    return F.when(kind.startswith("OBJECT"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))).when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(none)


def _own_keys(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))).otherwise(F.array().cast("array<string>"))


def has_dangerous_key(c: Column | str) -> Column:
    """Whether a key that could change prototypes occurs down to ``DEPTH`` levels below the top; false where the text is no JSON.

    The tree is walked level by level. Where keys are repeated, which the walk cannot
    read, a dangerous key at any depth counts.
    """
    text = F.col(c) if isinstance(c, str) else c
    v = F.try_parse_json(text)
    bad = lambda v: F.arrays_overlap(_own_keys(v), F.array(*map(F.lit, sorted(DANGEROUS_KEYS))))
    start = F.struct(F.array(v).alias("level"), F.lit(False).alias("hit"))
    step = lambda s, _: F.struct(F.when(s["hit"], F.from_json(F.lit("[]"), "array<variant>")).otherwise(F.flatten(F.transform(s["level"], _inner))).alias("level"), (s["hit"] | F.coalesce(F.exists(s["level"], bad), F.lit(False))).alias("hit"))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH)), start, step, lambda s: s["hit"])
    repeated = v.isNull() & (F.json_object_keys(text).isNotNull() | F.json_array_length(text).isNotNull())
    keys = F.transform(F.regexp_extract_all(text, F.lit(_TEXTS), F.lit(0)), lambda k: F.regexp_extract(k, _KEY, 1))
    return F.when(v.isNotNull(), walked).when(repeated, F.arrays_overlap(keys, F.array(*map(F.lit, sorted(DANGEROUS_KEYS))))).otherwise(False)
