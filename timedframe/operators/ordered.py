"""Ordered computations per key that survive a key holding a large share of all rows.

``scan`` is the one entry point.  Unless the tables below are small, it first measures the largest group with a map-side
combined count.  When that group fits in one task a plain window does the job with a single shuffle.
Otherwise rows are range partitioned by (key, order), so that a hot key spreads over many blocks;
each block computes local running values and one summary row, the summaries are scanned per key,
and the carried-in value is joined back by (key, block).
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUP_LIMIT_CONF = "timedframe.maxGroupRows"
GROUP_LIMIT_DEFAULT = 1_000_000
#: Bytes of stored tables that one row of a derived table stands for at least, when no group is measured.
ROW_BYTES = 64


def group_limit(spark: SparkSession) -> int:
    """Rows of one key that a single task may hold in sort order."""
    return int(spark.conf.get(GROUP_LIMIT_CONF, str(GROUP_LIMIT_DEFAULT)))


def shared_folder(spark: SparkSession) -> str:
    """Folder for cut lineage: the cluster's ``spark.checkpoint.dir``; a local one only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="timedframe-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back, so later branches prune columns of one result.

    The copy is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/timedframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def input_bytes(df: DataFrame) -> int:
    """Size of the tables that a plan reads, by the optimizer's estimate; starts no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


#: Stored bytes of a table per task, where a step's tasks follow from the size of what it reads.
TASK_BYTES = 8 << 20
MOST_TASKS = 10_000


#: What Spark says of a table whose size it doesn't know.
UNKNOWN_BYTES = (1 << 63) - 1


def task_count(source: DataFrame) -> int | None:
    """Tasks for a step over what stems from ``source``: one for each ``TASK_BYTES`` stored, at least one per core; none if its size isn't known."""
    stored = input_bytes(source)
    if stored >= UNKNOWN_BYTES:
        return None
    return min(MOST_TASKS, max(source.sparkSession.sparkContext.defaultParallelism, math.ceil(stored / TASK_BYTES)))


def shared_out(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``rows`` spread by key over more tasks as ``source``, which they stem from, grows, so that a task's share stays the same.

    Spark's own number of shuffle partitions is fixed, and what one of them holds grows with the input.
    """
    return rows.repartition(task_count(source) or MOST_TASKS, *keys)


def fits(df: DataFrame, keys: Sequence[str], factor: int = 1) -> bool:
    """Whether every key, with up to ``factor`` derived rows per row, stays within one task's limit.

    Tables that are small as a whole need no look at their groups, so that no job starts while a plan over them is built;
    larger ones are measured by one count, and so is every table where the session sets a limit of its own.
    Operators with several ordered steps ask once and hand the answer to each step.
    """
    return small_as_a_whole(df, factor) or largest_group(df, keys) * factor <= group_limit(df.sparkSession)


def small_as_a_whole(df: DataFrame, factor: int = 1) -> bool:
    """Whether the tables below are too small for a group past the limit, which the session didn't set itself."""
    own = df.sparkSession.conf.get(GROUP_LIMIT_CONF, None) is not None
    return not own and input_bytes(df) * factor <= ROW_BYTES * group_limit(df.sparkSession)


@dataclass(frozen=True)
class Run:
    """One running value; ``kind`` is sum, max, min or last."""

    kind: str
    value: Column
    inclusive: bool = True


def run_sum(value: Column, inclusive: bool = True) -> Run:
    return Run("sum", value, inclusive)


def run_count(inclusive: bool = True) -> Run:
    """Running row count; inclusive it equals ``row_number``."""
    return Run("sum", F.lit(1).cast("bigint"), inclusive)


def run_max(value: Column, inclusive: bool = True) -> Run:
    return Run("max", value, inclusive)


def run_min(value: Column, inclusive: bool = True) -> Run:
    return Run("min", value, inclusive)


def run_last(value: Column, inclusive: bool = True) -> Run:
    """Most recent non-null value in order."""
    return Run("last", value, inclusive)


def prior(value: Column) -> Run:
    """The previous row's value, NULL included (``lag``); it returns a struct with field ``v``."""
    return Run("last", F.struct(value.alias("v")), False)


def _fold(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    runs: dict[str, Run],
    bounded: bool | None = None,
) -> DataFrame:
    """Add running values per key in a total order (put a tie-break last in ``order``).

    ``bounded=True`` says that the caller has proven every key small, for instance rows that were
    exploded from one cell, and ``False`` that it is not; left open, the groups are measured here.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    limit = group_limit(df.sparkSession)
    if fits(df, keys) if bounded is None else bounded:
        base = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
        return df.select(
            "*",
            *[
                _fold(r.kind, r.value).over(base.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)).alias(n)
                for n, r in runs.items()
            ],
        )
    return _scan_blocks(df, list(keys), order, runs, limit)


def _scan_blocks(df: DataFrame, keys: list[str], order: list[Column], runs: dict[str, Run], limit: int) -> DataFrame:
    rows = df.count()
    n = max(2, math.ceil(2 * rows / limit))
    held = df.select("*", *[r.value.alias(f"_v_{n}") for n, r in runs.items()])
    ranged = held.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order)
    held = materialize(ranged.withColumn("_blk", F.spark_partition_id()))

    block = Window.partitionBy(*keys, "_blk").orderBy(*order)
    local = held.select(
        "*",
        *[
            _fold(r.kind, F.col(f"_v_{n}")).over(block.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)).alias(f"_l_{n}")
            for n, r in runs.items()
        ],
    )
    # One row per (key, block): its whole fold, with "last" taken by order through the local window.
    whole = [
        (F.last(F.col(f"_v_{n}"), ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"_w_{n}"))
        for n, r in runs.items()
        if r.kind == "last"
    ]
    parts = held.select("*", *whole) if whole else held
    summary = parts.groupBy(*keys, "_blk").agg(
        *[
            (F.first(f"_w_{n}") if r.kind == "last" else _fold(r.kind, F.col(f"_v_{n}"))).alias(f"_s_{n}")
            for n, r in runs.items()
        ]
    )
    # repartitionByRange hands out partitions in the requested order, so block numbers ascend with it.
    over_blocks = Window.partitionBy(*keys).orderBy("_blk") if keys else Window.orderBy("_blk")
    before = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_blk").alias("_kb"),
        *[_fold(r.kind, F.col(f"_s_{n}")).over(before).alias(f"_c_{n}") for n, r in runs.items()],
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col("_blk") == F.col("_kb"),
    )
    joined = local.join(carry, on)
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[_merge(r.kind, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, r in runs.items()],
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, bounded: bool | None = None) -> DataFrame:
    """1-based position in order."""
    return scan(df, keys, order, {name: run_count()}, bounded)


def lag_lead(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
    bounded: bool | None = None,
) -> DataFrame:
    """Neighbour values over ascending column names: ``lags`` from the row before, ``leads`` from the row after."""
    names = list(df.columns)
    out = df
    if bounded is None:
        bounded = fits(df, keys)
    if bounded:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select(
            "*",
            *[F.lag(v).over(w).alias(n) for n, v in (lags or {}).items()],
            *[F.lead(v).over(w).alias(n) for n, v in (leads or {}).items()],
        )
    if lags:
        out = scan(out, keys, [F.col(o).asc() for o in order], {n: prior(v) for n, v in lags.items()}, bounded)
    if leads:
        out = scan(out, keys, [F.col(o).desc() for o in order], {n: prior(v) for n, v in leads.items()}, bounded)
    added = [*(lags or {}), *(leads or {})]
    return out.select(*[F.col(f"`{c}`") for c in names], *[F.col(n)["v"].alias(n) for n in added])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row that comes first by ascending ``order``: a map-side combined aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*[F.col(c) if c in keys else F.col("row")[c].alias(c) for c in df.columns])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key, the last by ascending ``order`` and then by its own values; a side table that may repeat keys."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("row"))
    return picked.select(*[F.col(c) if c in keys else F.col("row")[c].alias(c) for c in df.columns])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "_rn") -> DataFrame:
    """First ``n`` rows per key; Spark cuts each map task to ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def attach_group(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Give each row its group's aggregates: partial aggregation and an equi-join that AQE may split,
    instead of an unbounded window that would put a whole group into one task."""
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    if not keys:
        return df.crossJoin(F.broadcast(stats))  # exactly one row
    renamed = stats.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *aggs)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(renamed, on).drop(*[f"_g_{k}" for k in keys])
