"""Places where a user's own code joins in: filters, hooks, providers and metadata actions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timedframe.functions.templates import apply_actions, register_action  # noqa: F401

# Points of the processing chain, in order
POINTS = ["pre_process", "after_filter", "video", "before_dl", "post_process", "after_move", "after_video", "playlist"]

Hook = Callable[[DataFrame], DataFrame]


def apply_hooks(df: DataFrame, hooks: Mapping[str, Sequence[Hook]], until: str | None = None) -> DataFrame:
    """Run table-to-table hooks in the order of their points, up to and including ``until``."""
    unknown = set(hooks) - set(POINTS)
    if unknown:
        raise ValueError(f"unknown points: {sorted(unknown)}")
    points = POINTS[: POINTS.index(until) + 1] if until else POINTS
    return reduce(lambda d, h: d.transform(h), [h for p in points for h in hooks.get(p, ())], df)


def user_filters(df: DataFrame, filters: Sequence[Callable[[DataFrame], Column]], reason: str = "reject_reason") -> DataFrame:
    """All rows with the message of the first filter that objects, NULL where none does; a filter gives a message column of its table."""
    return df.withColumn(reason, F.coalesce(*[f(df).cast("string") for f in filters], F.lit(None).cast("string")))


def apply_provider(
    df: DataFrame,
    provider: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | StructType,
    rows: int = 1000,
    tries: int = 1,
    wait: float = 0.0,
    errors: str | None = None,
) -> DataFrame:
    """Work of an outside engine (recognition, speech, translation) on at most ``rows`` rows a call.

    A call that raises is repeated up to ``tries`` times, after ``wait`` seconds and then twice as long each time.  A batch that still fails
    is halved, so that one bad row doesn't fail others.  A single row that fails is an error of the query, or, with ``errors``
    (a text column of ``schema``), a row with the message there, its own columns and NULL elsewhere.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if rows < 1 or tries < 1:
        raise ValueError("rows and tries are 1 or more")
    if errors is not None and errors not in schema.names:
        raise ValueError(f"no column {errors} in the schema")
    names = schema.names

    def shaped(out: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: out[c] if c in out else pd.Series([None] * len(out), out.index, object) for c in names})

    def attempt(part: pd.DataFrame) -> pd.DataFrame:
        for n in range(tries):
            try:
                return provider(part.copy())
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(wait * 2**n)
        raise AssertionError

    def parts(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            out = attempt(part)
        except Exception as e:
            if len(part) > 1:
                half = len(part) // 2
                yield from parts(part.iloc[:half].reset_index(drop=True))
                yield from parts(part.iloc[half:].reset_index(drop=True))
                return
            if errors is None:
                raise
            out = part.assign(**{errors: f"{type(e).__name__}: {e}"})
        yield out if errors is None else shaped(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                yield from parts(pdf.iloc[at : at + rows].reset_index(drop=True))

    return df.mapInPandas(run, schema)
