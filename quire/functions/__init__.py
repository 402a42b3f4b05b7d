"""Column helpers with the catalog's truthiness rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Null or empty text."""
    return c.isNull() | (c == "")


def text_or(c: Column, default: Column | str) -> Column:
    """``c``, or ``default`` where it is null or empty (unlike coalesce)."""
    return F.when(blank(c), default if isinstance(default, Column) else F.lit(default)).otherwise(c)


def number_or(c: Column, default: int = 0) -> Column:
    """A text read as a whole number; ``default`` where it is none."""
    return F.coalesce(c.try_cast("bigint"), F.lit(default))


def truthy(c: Column) -> Column:
    """Whether a text is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def is_flag(c: Column) -> Column:
    """The texts that count as true: ``true`` and ``1``."""
    return F.coalesce(c.isin("true", "1"), F.lit(False))


def within(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def stripped(c: Column) -> Column:
    """``c`` without white space of any kind at its ends."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c\u00a0\u3000\ufeff"))
