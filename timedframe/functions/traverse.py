"""Paths into nested columns: keys, indexes, slices, wildcards, filters and alternatives.

The path is resolved against the table's schema on the driver; what remains is a plain column expression.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = str | int | slice | Callable[[Column], Column] | type(...) | tuple


def _null() -> tuple[Column, T.DataType]:
    return F.lit(None), T.NullType()


def _walk(value: Column, kind: T.DataType, path: tuple) -> tuple[Column, T.DataType]:
    if not path:
        return value, kind
    step, rest = path[0], path[1:]
    if isinstance(step, tuple):
        found = [_walk(value, kind, (*(s if isinstance(s, tuple) else (s,)), *rest)) for s in step]
        found = [(c, k) for c, k in found if not isinstance(k, T.NullType)]
        return (F.coalesce(*[c for c, _ in found]), found[0][1]) if found else _null()
    if step is ... or callable(step) or isinstance(step, slice):
        if isinstance(kind, T.MapType):
            value, kind = F.map_values(value), T.ArrayType(kind.valueType)
        if isinstance(kind, T.StructType):
            same = [f for f in kind.fields if f.dataType == kind.fields[0].dataType]
            value, kind = F.array(*[value[f.name] for f in same]), T.ArrayType(kind.fields[0].dataType)
        if not isinstance(kind, T.ArrayType):
            return _null()
        items = value
        if callable(step):
            items = F.filter(items, step)
        elif isinstance(step, slice):
            if step.step not in (None, 1):
                raise ValueError("slices take no step")
            n = F.size(items)
            at = lambda i, default: default if i is None else (F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0)))
            lo, hi = at(step.start, F.lit(0)), at(step.stop, n)
            items = F.slice(items, lo + 1, F.greatest(F.least(hi, n) - lo, F.lit(0)))
        inner = kind.elementType
        if rest:
            probe = _walk(F.lit(None).cast(inner), inner, rest)[1]
            if isinstance(probe, T.NullType):
                return _null()
            items, inner = F.transform(items, lambda x: _walk(x, kind.elementType, rest)[0]), probe
            if any(r is ... or callable(r) or isinstance(r, slice) for r in rest):
                items, inner = F.flatten(F.filter(items, lambda x: x.isNotNull())), probe.elementType
        return F.filter(items, lambda x: x.isNotNull()), T.ArrayType(inner)
    if isinstance(step, int) and isinstance(kind, T.ArrayType):
        return _walk(F.try_element_at(value, F.lit(step + 1 if step >= 0 else step)), kind.elementType, rest)
    if isinstance(step, str) and isinstance(kind, T.StructType) and step in kind.names:
        return _walk(value[step], kind[step].dataType, rest)
    if isinstance(kind, T.MapType):
        return _walk(F.try_element_at(value, F.lit(step)), kind.valueType, rest)
    return _null()


def traverse(df: DataFrame, *paths: tuple, default=None) -> Column:
    """Value at the first path that leads somewhere (empty lists count as nowhere).

    Steps: ``"key"``, ``0``, ``slice(a, b)``, ``...`` for every item, a function of the item for those
    that satisfy it, and a tuple of alternatives.
    """
    out = []
    for path in paths:
        head, *rest = path
        if head not in df.columns:
            continue
        value, kind = _walk(F.col(head), df.schema[head].dataType, tuple(rest))
        if isinstance(kind, T.NullType):
            continue
        out.append(F.when(F.size(value) > 0, value) if isinstance(kind, T.ArrayType) else value)
    if default is not None:
        out.append(F.lit(default))
    return F.coalesce(*out) if out else F.lit(None)


def variant_path(column: str, path: tuple, kind: str) -> Column:
    """Typed value at a path of keys and indexes inside a VARIANT column; NULL where it does not fit."""
    text = reduce(lambda t, s: f"{t}[{s}]" if isinstance(s, int) else f"{t}.{s}", path, "$")
    return F.try_variant_get(F.col(column), text, kind)
