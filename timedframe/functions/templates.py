"""Output templates and metadata rules compiled to columns.

Template subset: ``%(field.path+1>strftime,alternate&replacement|default)s`` with the conversions
s d i f l j h q U D S B, plus ``%%``.  Anything else raises when the template is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timedframe.functions.scalars import decimal_suffix, sanitize_filename
from timedframe.operators.formats import format_bytes

MISSING = "NA"
PLACE = re.compile(r"%\((?P<body>[^)]*)\)(?P<flags>[-0 +#]*)(?P<width>\d*)(?:\.(?P<prec>\d+))?(?P<conv>[sdifljhqUDSB])|%%")
VALUE = re.compile(r"(?P<neg>-)?(?P<path>\w+(?:\.-?\w+)*)(?P<maths>(?:[+*-](?:\d+(?:\.\d+)?|[a-z_]+))*)(?:>(?P<strf>.+))?")
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "j": "DDD", "p": "a", "I": "hh", "a": "EEE", "A": "EEEE"}


def _type(df: DataFrame, c: Column) -> T.DataType:
    return df.select(c.alias("v")).schema[0].dataType


def _path(df: DataFrame, path: str) -> Column:
    head, *rest = path.split(".")
    if head not in df.columns:
        return F.lit(None).cast("string")
    out = F.col(head)
    for key in rest:
        kind = _type(df, out)
        if isinstance(kind, T.ArrayType):
            out = F.try_element_at(out, F.lit(int(key) + 1 if int(key) >= 0 else int(key)))
        elif isinstance(kind, T.MapType):
            out = F.try_element_at(out, F.lit(key))
        elif isinstance(kind, T.StructType) and key in kind.names:
            out = out[key]
        else:
            return F.lit(None).cast("string")
    return out


def java_pattern(strf: str) -> str:
    """strftime pattern as a Spark date pattern."""
    out, text = [], ""
    i = 0

    def flush():
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'")
        text = ""

    while i < len(strf):
        if strf[i] == "%" and i + 1 < len(strf):
            code = strf[i + 1]
            if code == "%":
                text += "%"
            elif code in STRFTIME:
                flush()
                out.append(STRFTIME[code])
            else:
                raise ValueError(f"date code %{code} is not supported")
            i += 2
        else:
            text += strf[i]
            i += 1
    flush()
    return "".join(out)


def _value(df: DataFrame, text: str) -> Column:
    m = VALUE.fullmatch(text)
    if not m:
        raise ValueError(f"template field {text!r} is not supported")
    out = _path(df, m["path"])
    if m["neg"] or m["maths"]:
        out = out.try_cast("double") if isinstance(_type(df, out), T.StringType) else out
    if m["neg"]:
        out = -out
    for op, arg in re.findall(r"([+*-])(\d+(?:\.\d+)?|[a-z_]+)", m["maths"]):
        other = F.lit(float(arg) if "." in arg else int(arg)) if arg[0].isdigit() else _path(df, arg)
        out = {"+": out + other, "-": out - other, "*": out * other}[op]
    if m["strf"]:
        kind = _type(df, out)
        day = F.to_timestamp(F.try_to_date(out.cast("string"), "yyyyMMdd"))
        at = out.cast("timestamp") if isinstance(kind, (T.TimestampType, T.DateType)) else F.coalesce(day if isinstance(kind, T.StringType) else F.lit(None).cast("timestamp"), F.timestamp_seconds(out.try_cast("double")))
        out = F.date_format(at, java_pattern(m["strf"].replace("\\,", ",")))
    return out


def _text(df: DataFrame, c: Column) -> Column:
    kind = _type(df, c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def _pad(c: Column, flags: str, width: str) -> Column:
    if not width:
        return c
    w = int(width)
    filled = F.rpad(c, w, " ") if "-" in flags else F.lpad(c, w, "0" if "0" in flags else " ")
    return F.when(F.length(c) < w, filled).otherwise(c)


def _convert(df: DataFrame, c: Column, conv: str, flags: str, width: str, prec: str | None) -> Column:
    """Formatted text; NULL stays NULL so that alternates and defaults apply."""
    kind = _type(df, c)
    if conv in "di":
        n = c.try_cast("double") if isinstance(kind, T.StringType) else c
        return _pad(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("bigint").cast("string"), flags, width)
    if conv == "f":
        n = c.try_cast("double") if isinstance(kind, T.StringType) else c.cast("double")
        return _pad(F.when(n.isNotNull(), F.format_string(f"%.{prec or 6}f", n)), flags, width)
    if conv == "l":
        out = F.array_join(c.cast("array<string>"), "\n" if "#" in flags else ", ") if isinstance(kind, T.ArrayType) else _text(df, c)
    elif conv == "j":
        out = F.when(c.isNotNull(), F.to_json(c)) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else (
            F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1) if isinstance(kind, T.StringType) else c.cast("string")
        )
    elif conv == "h":
        t = _text(df, c)
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            t = F.replace(t, F.lit(a), F.lit(b))
        out = t
    elif conv == "q":
        t = _text(df, c)
        out = F.when(t.rlike(r"^[a-zA-Z0-9@%+=:,./_-]+$"), t).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))
        out = F.when(t.isNotNull(), out)
    elif conv == "D":
        out = decimal_suffix(c.try_cast("double") if isinstance(kind, T.StringType) else c)
    elif conv == "S":
        out = sanitize_filename(_text(df, c))
    elif conv == "B":
        n = F.octet_length(_text(df, c)) if isinstance(kind, T.StringType) else c
        out = F.when(n.isNotNull(), format_bytes(n))
    else:
        out = _text(df, c)
    if prec and conv == "s":
        out = F.substring(out, 1, int(prec))
    return _pad(out, flags, width)


def template(df: DataFrame, text: str, missing: str = MISSING) -> Column:
    """One column that renders the template for every row."""
    parts: list[Column] = []
    at = 0
    for m in PLACE.finditer(text):
        if m.start() > at:
            parts.append(F.lit(text[at : m.start()]))
        at = m.end()
        if m[0] == "%%":
            parts.append(F.lit("%"))
            continue
        body, _, default = m["body"].partition("|")
        fields, amp, replacement = body.partition("&")
        options = [_convert(df, _value(df, f.strip()), m["conv"], m["flags"], m["width"], m["prec"]) for f in re.split(r"(?<!\\),", fields) if f]
        value = F.coalesce(*options) if options else F.lit(None).cast("string")
        if amp:
            before, hole, after = replacement.partition("{}")
            made = F.concat(F.lit(before), value, F.lit(after)) if hole else F.lit(replacement)
            value = F.when(value.isNotNull(), made)
        parts.append(F.coalesce(value, F.lit(default if "|" in m["body"] else missing)))
    if at < len(text):
        parts.append(F.lit(text[at:]))
    if re.search(r"%\(", PLACE.sub("", text)):
        raise ValueError(f"unsupported place in template {text!r}")
    return F.concat(*parts) if parts else F.lit("")


# ---- metadata rules ------------------------------------------------------------------------------


def _target(to: str) -> tuple[str, list[str]]:
    """Pattern and group names of a target: a template becomes a regex, named groups become positions."""
    if re.fullmatch(r"\w+", to):
        return r"(?s)^(.+)$", [to]
    if "%(" in to:
        names = re.findall(r"%\((\w+)\)s", to)
        pieces = re.split(r"%\(\w+\)s", to)
        body = "".join(re.escape(p).replace("\\ ", " ") + f for p, f in zip(pieces, [*["(.+)"] * len(names), ""]))
        return "(?s)" + body, names
    groups = re.findall(r"\((?!\?)|\(\?P<(\w+)>", to)
    return "(?s)" + re.sub(r"\(\?P<\w+>", "(", to), groups


def interpret(df: DataFrame, source: str, to: str) -> DataFrame:
    """FROM:TO rule: the source field or template is matched and its groups become columns where it matches."""
    text = _text(df, F.col(source)) if re.fullmatch(r"\w+", source) and source in df.columns else template(df, source)
    pattern, names = _target(to)
    hit = text.rlike(pattern)
    new = {}
    for i, name in enumerate(names, 1):
        if name:
            old = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
            new[name] = F.when(hit, F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))).otherwise(old)
    return df.withColumns(new)


def replace(df: DataFrame, field: str, pattern: str, repl: str) -> DataFrame:
    return df.withColumn(field, F.regexp_replace(field, pattern, re.sub(r"\\(\d)", r"$\1", repl.replace("$", "\\$"))))


ACTIONS: dict[str, Callable[..., DataFrame]] = {"interpret": interpret, "replace": replace}


def register_action(name: str, action: Callable[..., DataFrame]) -> None:
    """Add a metadata action: a function of a table and text arguments that returns a table."""
    ACTIONS[name] = action


def apply_actions(df: DataFrame, actions: list[tuple]) -> DataFrame:
    return reduce(lambda d, a: ACTIONS[a[0]](d, *a[1:]), actions, df)
