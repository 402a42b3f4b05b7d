"""Open JSON objects as maps of variants: merging by key presence, canonical text.

An object is read strictly: text behind it, a second object, a cut-off text or a
repeated key inside a value make it unreadable, and ``entries`` is null. A key that
is repeated at the top counts with its last value. Changes to an unreadable object
leave its text as it is (``kept``); ``readable`` tells which those are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import blank

MAP = "map<string,variant>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _last_of_each(pairs: Column) -> Column:
    """A map without the earlier ones of repeated keys."""
    keys = F.map_keys(pairs)
    later = lambda k, i: F.array_contains(F.slice(keys, i + 2, F.size(keys)), k)
    once = F.map_from_entries(F.filter(F.map_entries(pairs), lambda e, i: ~later(e["key"], i)))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), once).otherwise(pairs)


def entries(json: Column) -> Column:
    """A JSON object as a map: empty for null or blank, null for what is no readable object. A JSON null stays a value of its key."""
    # as the only element of a list, so that nothing may follow the object
    bare = F.btrim(json, F.lit(" \t\n\r"))
    # what has no braces at its ends is not read at all: to fail at a text costs more than to read it
    given = F.when(blank(F.trim(json)), F.lit("[{}]")).when(bare.startswith("{") & bare.endswith("}"), F.concat(F.lit("["), json, F.lit("]")))
    return let(F.from_json(given, f"array<{MAP}>"), lambda found: F.when(F.size(found) == 1, let(F.get(found, F.lit(0)), _last_of_each)))


def readable(json: Column) -> Column:
    return entries(json).isNotNull()


def text(pairs: Column) -> Column:
    """A map as JSON with its keys in order."""
    by_key = lambda p: F.map_from_entries(F.array_sort(F.map_entries(p), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))
    return F.to_json(let(pairs, by_key))


def over(old: Column, new: Column) -> Column:
    """Both maps, the values of ``new`` where both have a key, whatever they are."""
    return let(new, lambda n: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(n, k)), n))


def kept(old: Column, changed: Column) -> Column:
    """The text of a changed map, or the old text where a map was unreadable."""
    return F.coalesce(text(changed), old)


def has_key(json: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def merged(old: Column, new: Column) -> Column:
    """JSON objects merged one level deep: a key of ``new`` overwrites, also with null."""
    return kept(old, over(entries(old), entries(new)))


def without(json: Column, keys: tuple[str, ...], extra: Column | None = None) -> Column:
    """A JSON object without some keys, with those of ``extra`` added."""
    left = F.map_filter(entries(json), lambda k, _: ~k.isin(*keys))
    return kept(json, left if extra is None else over(left, entries(extra)))
