"""The event log: JSON lines, one folder per date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedframe.schemas import EVENT


def log_rows(events: DataFrame, service: str) -> DataFrame:
    """Rows as the log keeps them: epoch seconds, service and the date that names the folder."""
    at = F.unix_micros("ts") / F.lit(1e6)
    return events.withColumns({"date": F.to_date("ts"), "ts": at, "service": F.lit(service)})


def write_events(events: DataFrame, path: str, service: str, checkpoint: str | None = None):
    """Append a batch, or start an appending stream when ``events`` is one.

    A stream needs a checkpoint folder and a log folder of its own: its commit log decides which files
    readers see there, which gives each event exactly once.
    """
    rows = log_rows(events, service)
    if not events.isStreaming:
        rows.write.mode("append").partitionBy("date").json(path)
        return None
    return (
        rows.writeStream.format("json").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )


def read_events(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Log rows with a declared schema; ``since`` prunes whole date folders."""
    rows = spark.read.schema(EVENT).json(path)
    return rows.filter(F.col("date") >= F.lit(since).cast("date")) if since else rows
