"""Null, text and rounding rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters of Unicode white space, those that ``(?U)\s`` matches.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Unicode white space on both ends (Spark's own trim knows U+0020 only); a pattern would search the whole text."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def blank(c: Column | str) -> Column:
    """True for NULL and for text of white space only."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def known(predicate: Column, when_null: bool = False) -> Column:
    """Two-valued predicate: an unknown answer becomes ``when_null``."""
    return F.coalesce(predicate, F.lit(when_null))


def secs(c: Column | str) -> Column:
    """Timestamp to epoch seconds as DOUBLE, exact to the microsecond."""
    return F.unix_micros(col(c)) / F.lit(1_000_000.0)


def r2(c: Column | str) -> Column:
    return F.bround(col(c), 2)


def r4(c: Column | str) -> Column:
    """Rounding of doubles that leave a checked query; ``+ 0.0`` removes negative zero."""
    return F.round(col(c) * F.lit(10000.0)) / F.lit(10000.0) + F.lit(0.0)


def once(value: Column, f) -> Column:
    """``f(value)`` where a costly ``value`` that ``f`` uses many times is computed a single time per row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
