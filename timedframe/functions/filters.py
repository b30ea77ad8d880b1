"""Filter strings turned into Spark columns, so that Catalyst sees and pushes down the predicates."""

from __future__ import annotations

import math
import re
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


PREFIXES = "KMGTPEZY"


def size_units() -> dict[str, int]:
    """Spellings of byte units: ``KiB`` and ``kB`` count in 1024, ``KB``, ``Kb`` and ``kb`` in 1000."""
    units = {"B": 1, "b": 1, "bytes": 1}
    names = ["kilo", "mega", "giga", "tera", "peta", "exa", "zetta", "yotta"]
    for i, p in enumerate(PREFIXES, 1):
        for spelling, base in ((f"{p}iB", 1024), (f"{p}B", 1000), (f"{p.lower()}B", 1024), (f"{p}b", 1000), (f"{p.lower()}b", 1000)):
            units[spelling] = base**i
        units[f"{names[i - 1]}bytes"] = 1000**i
        units[f"{names[i - 1][:2]}bibytes"] = 1024**i
    return units


def size_literal(text: str) -> int | None:
    m = re.fullmatch(r"([0-9]+(?:[.,][0-9]*)?)\s*([A-Za-z]+)", text.strip())
    unit = size_units().get(m.group(2)) if m else None
    return round(float(m.group(1).replace(",", ".")) * unit) if unit else None


# Spellings of units from large to small, with the seconds that one of them counts
DATE_UNITS = [(["y", "year", "years"], 0), (["m", "month", "months"], 0), (["w", "week", "weeks"], 0), (["d", "day", "days"], 86400)]
TIME_UNITS = [(["h", "hr", "hrs", "hour", "hours"], 3600), (["m", "min", "mins", "minute", "minutes"], 60), (["s", "sec", "secs", "second", "seconds"], 1)]
BROKEN_UNITS = {"hour": 3600, "hours": 3600, "min": 60, "mins": 60, "min.": 60, "mins.": 60, "minute": 60, "minutes": 60}
CLOCK = r"\d+(:\d+)*(\.\d+)?"
AMOUNT = r"(\d+(?:\.\d+)?)\s*([a-z]+)"


def _amount_literal(text: str, units: list[tuple[list[str], int]]) -> float | None:
    """Sum of ``number unit`` pairs that fill the text, from large to small units; only seconds have a fraction."""
    pairs = re.findall(AMOUNT, text)
    order = [next((i for i, (names, _) in enumerate(units) if u in names), None) for _, u in pairs]
    if re.sub(AMOUNT + r",?\s*", "", text) or None in order or order != sorted(set(order)):
        return None
    if any("." in n and units[i][1] != 1 for (n, _), i in zip(pairs, order)):
        return None
    return float(sum(float(n) * units[i][1] for (n, _), i in zip(pairs, order)))


def duration_literal(text: str) -> float | None:
    """A duration in a filter by the grammar of ``scalars.parse_duration``."""
    s = text.strip().lower().removesuffix("z")
    if re.fullmatch(CLOCK, s, re.ASCII):
        *upper, last = s.split(":")
        fraction = 0.0
        if upper and ((len(last) > 2 and "." not in last) or len(upper) > 3):
            fraction, last = float("0." + last), upper.pop()
        places = [last, *reversed(upper)]
        return sum(float(n) * w for n, w in zip(places, (1, 60, 3600, 86400))) + fraction if len(places) <= 4 else None
    marked = re.search(r"t(?=\d|$)", s)
    date, time = (s[: marked.start()].removeprefix("p"), s[marked.end() :]) if marked else ("", s)
    parts = [_amount_literal(date, DATE_UNITS), _amount_literal(time, TIME_UNITS)]
    if s and None not in parts:
        return sum(parts)
    number = re.match(r"[\d.]+", s)
    unit = BROKEN_UNITS.get(s[number.end() :].strip()) if number else None
    try:
        return float(number.group()) * unit if unit else None
    except ValueError:
        return None


def number_literal(text: str) -> float | int | None:
    try:
        return int(text)
    except ValueError:
        pass
    for value in (size_literal(text), size_literal(text + "B"), duration_literal(text)):
        if value is not None:
            return value
    return None


def _compare(column: Column, op: str, value) -> Column:
    return {
        "<": lambda: column < value,
        "<=": lambda: column <= value,
        ">": lambda: column > value,
        ">=": lambda: column >= value,
        "=": lambda: column == value,
        "*=": lambda: F.contains(column, F.lit(value)),
        "^=": lambda: F.startswith(column, F.lit(value)),
        "$=": lambda: F.endswith(column, F.lit(value)),
        "~=": lambda: column.rlike(value),
    }[op]()


def _field(df: DataFrame, key: str) -> tuple[Column, T.DataType]:
    """Column and type of a key; a key the table does not have is an unknown value."""
    for f in df.schema.fields:
        if f.name == key:
            return F.col(key), f.dataType
    return F.lit(None).cast("string"), T.StringType()


OPERATORS = ("<=", ">=", "*=", "^=", "$=", "~=", "<", ">", "=")
TEXT_ONLY = ("*=", "^=", "$=", "~=")
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
MATCH_KEY = LOWER + "_"
FORMAT_KEY = LOWER + LOWER.upper() + DIGITS + "_.-"


@dataclass(frozen=True)
class Term:
    """``key``, ``!key`` or ``key [!] operator [?] value``; ``?`` lets unknown values pass."""

    key: str
    negated: bool
    operator: str | None = None
    unknown_passes: bool = False
    value: str | None = None
    quote: str = ""


def read_term(text: str, key_letters: str) -> Term:
    """One term, read from left to right: blanks may stand between its parts."""
    rest = text.strip()

    def take(*options: str) -> str:
        nonlocal rest
        found = next((o for o in options if rest.startswith(o)), "")
        rest = rest[len(found) :].lstrip()
        return found

    lead = bool(take("!"))
    size = len(rest) - len(rest.lstrip(key_letters))
    key, rest = rest[:size], rest[size:].lstrip()
    if not key:
        raise ValueError(f"a field name is missing in {text!r}")
    if not rest:
        return Term(key, lead)
    inner = bool(take("!"))
    operator = take(*OPERATORS)
    unknown_passes = bool(operator and take("?"))
    if lead or not operator or not rest:
        raise ValueError(f"{text!r} is neither a field nor a comparison")
    quote = rest[0] if rest[0] in "\"'" and rest[0] == rest[-1] and len(rest) > 2 else ""
    value = rest[1:-1].replace("\\" + quote, quote) if quote else rest
    return Term(key, inner, operator, unknown_passes, value, quote)


def _term(df: DataFrame, text: str, incomplete: Collection[str] | bool) -> Column:
    term = read_term(text, MATCH_KEY)
    column, kind = _field(df, term.key)
    if term.operator is None:
        present = column if isinstance(kind, T.BooleanType) else column.isNotNull()
        hit = present if not term.negated else ~present | column.isNull()
    elif isinstance(kind, T.NumericType):
        number = number_literal(term.value)
        if number is None and term.operator != "=":
            raise ValueError(f"{term.value!r} is not a number, in {text!r}")
        if number is not None and term.operator in TEXT_ONLY:
            raise ValueError(f"{term.key} holds numbers, {term.operator} compares texts, in {text!r}")
        hit = F.when(column.isNotNull(), F.lit(False)) if number is None else _compare(column, term.operator, F.lit(number))
    else:
        hit = _compare(column, term.operator, term.value)
    # left three-valued where unknown means no, so that a filter reaches the scan as a plain comparison
    if term.operator and term.negated:
        hit = ~hit
    unknown_passes = term.unknown_passes or (incomplete if isinstance(incomplete, bool) else term.key in incomplete)
    return hit | column.isNull() if unknown_passes else hit


def match_column(df: DataFrame, expr: str, incomplete: Collection[str] | bool = ()) -> Column:
    """All ``&``-joined terms of ``expr`` as one predicate; ``\\&`` is a literal ampersand.

    Unknown means no; wrap the result in ``known`` before negating it.
    """
    parts = [p.replace("\\&", "&") for p in re.split(r"(?<!\\)&", expr)]
    out = _term(df, parts[0], incomplete)
    for p in parts[1:]:
        out = out & _term(df, p, incomplete)
    return out


def _amount(text: str) -> float | None:
    """A number, perhaps with a byte prefix such as ``500k`` or ``1.5MiB``."""
    digits = text.rstrip(LOWER + LOWER.upper())
    if not digits or digits.strip(DIGITS + "."):
        return None
    if digits == text:
        return float(text) if text.count(".") <= 1 and text != "." else None
    found = size_literal(text)
    return found if found is not None else size_literal(text + "B")


def format_column(df: DataFrame, spec: str) -> Column:
    """One bracket filter of a format selector, such as ``height<=720`` or ``vcodec^=avc``."""
    term = read_term(spec, FORMAT_KEY)
    if term.operator is None:
        raise ValueError(f"a comparison is missing in {spec!r}")
    column, kind = _field(df, term.key)
    numeric = isinstance(kind, T.NumericType)
    amount = None if term.quote or term.operator in TEXT_ONLY else _amount(term.value)
    if term.operator not in ("=", *TEXT_ONLY) and (amount is None or term.negated):
        raise ValueError(f"{term.operator} needs a number in {spec!r}")
    if amount is not None and (numeric or term.operator != "="):
        hit = _compare(column if numeric else column.try_cast("double"), term.operator, F.lit(float(amount)))
    elif not term.quote and term.value.strip(FORMAT_KEY):
        raise ValueError(f"quote the value in {spec!r}")
    else:
        hit = _compare(column.cast("string"), term.operator, term.value)
    hit = ~hit if term.negated else hit
    return hit | column.isNull() if term.unknown_passes else hit


# ---- date bounds ---------------------------------------------------------------------------------

def date_bound(text: str, today: str) -> Column:
    """``20240131``, ``today``, ``today-2weeks``; months and years clamp to the month's end."""
    text = text.strip()
    day = F.lit(today).cast("date")
    named = {"now": day, "today": day, "yesterday": F.date_sub(day, 1)}
    word = next((w for w in named if text.startswith(w)), None)
    if word is None and not (len(text) >= 8 and text[:8].isdecimal()):
        raise ValueError(f"no date in {text!r}")
    start = named[word] if word else F.to_date(F.lit(text[:8]), "yyyyMMdd")
    step = text[len(word) if word else 8 :]
    if not step:
        return start
    count = step[1:].rstrip(LOWER)
    unit = step[1 + len(count) :].removesuffix("s")
    if step[0] not in "+-" or not count.isdecimal() or unit not in ("day", "week", "month", "year"):
        raise ValueError(f"no step of days, weeks, months or years in {text!r}")
    n = int(step[0] + count)
    return F.date_add(start, n * (7 if unit == "week" else 1)) if unit in ("day", "week") else F.add_months(start, n * (12 if unit == "year" else 1))


def playlist_slices(spec: str) -> list[tuple[int | None, float | None, int]]:
    """Parts of a playlist item spec as (start, stop, step) over 1-based positions, as written."""

    def whole(digits: str, part: str, endless: bool = False) -> int | float | None:
        if endless and digits in ("inf", "infinite"):
            return math.inf
        if digits and not digits.removeprefix(digits[0] if digits[0] in "+-" else "").isdecimal():
            raise ValueError(f"{part!r} is not a playlist item")
        return int(digits) if digits else None

    out = []
    for part in spec.split(","):
        sign = part[:1] if part[:1] in ("+", "-") else ""
        size = len(sign) + len(part) - len(sign) - len(part[len(sign) :].lstrip(DIGITS))
        head, tail = part[:size], part[size:]
        if head == sign:  # a sign without digits opens a range
            head, tail = "", part
        if not part or (tail and tail[0] not in ":-"):
            raise ValueError(f"{part!r} is not a playlist item")
        start = whole(head, part)
        if not tail:
            out.append((start, start, 1))
            continue
        stop, colon, step = tail[1:].partition(":")
        by = whole(step, part)
        if by == 0:
            raise ValueError(f"the step of {part!r} is zero")
        if colon and by is None:
            raise ValueError(f"{part!r} ends without a step")
        out.append((start, whole(stop, part, endless=True), by or 1))
    return out
