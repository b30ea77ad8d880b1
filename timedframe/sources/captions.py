"""Subtitle files: SRT and WebVTT in and out, and cue de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedframe.functions.scalars import group, srt_seconds, srt_time
from timedframe.operators.ordered import fits, lag_lead, number_rows, run_sum, scan
from timedframe.semantics import strip
from timedframe.sources.files import read_blocks, write_blocks

TICKS_PER_MS = 90
SRT_CLOCK = r"\d{1,2}:\d{2}:\d{2}[,.]\d{3}"


def _blocks(text: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")
    return F.filter(F.split(clean, r"\n[ \t]*(?:\n[ \t]*)+"), lambda b: F.length(strip(b)) > 0)


def parse_srt(files: DataFrame) -> DataFrame:
    """Cues of SRT texts (``media_id, text``, other columns stay): inner lines joined by a space, blank cues dropped."""
    keep = [c for c in files.columns if c != "text"]
    rows = files.select(*keep, F.posexplode(_blocks(F.col("text"))).alias("block", "_b"))
    p = rf"(?s)^\s*(?:\d+\s*\n)?\s*({SRT_CLOCK})\s*-->\s*({SRT_CLOCK})[^\n]*\n?(.*)$"
    clock = lambda i: srt_seconds(F.lpad(F.regexp_replace(group(F.col("_b"), p, i), ",", "."), 12, "0"))
    lines = F.filter(F.transform(F.split(F.regexp_extract("_b", p, 3), "\n"), strip), lambda l: F.length(l) > 0)
    rows = rows.filter(F.col("_b").rlike(p)).select(*keep, "block", clock(1).alias("start"), clock(2).alias("end"), F.array_join(lines, " ").alias("text"))
    return rows.filter(F.length("text") > 0)


def read_srt(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Cues of all ``.srt`` files below ``path``, named by their path there; (part, at, block) is their order in the file."""
    return parse_srt(read_blocks(spark, path, ".srt", stream))


def srt_blocks(cues: DataFrame, order: list[str], bounded: bool | None = None) -> DataFrame:
    """Numbered SRT blocks (``media_id, cue_no, block``) of cue rows (``media_id, start, end, line``)."""
    rows = number_rows(cues, ["media_id"], order, "cue_no", bounded)
    block = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), F.col("line"), F.lit("\n"))
    return rows.select("media_id", "cue_no", block.alias("block"))


def write_srt(cues: DataFrame, path: str, order: list[str], mode: str = "append", bounded: bool | None = None) -> None:
    """One SRT file per media (per media and task, if it is long), which ``read_srt`` finds under the same id.

    ``bounded`` is what the caller knows about the size of every media (see ``ordered.scan``).
    """
    blocks = srt_blocks(cues, order, bounded).select("media_id", F.col("cue_no").alias("ord"), F.col("block").alias("value"))
    write_blocks(blocks, path, ".srt", mode=mode, bounded=bool(bounded))


def _ticks(text: Column) -> Column:
    p = r"^(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})$"
    part = lambda i: F.coalesce(group(text, p, i).try_cast("bigint"), F.lit(0))
    return (((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)) * TICKS_PER_MS


def parse_webvtt(files: DataFrame) -> DataFrame:
    """Cues of WebVTT texts: id, start and end in 90 kHz ticks, settings and text; notes, styles and regions are skipped."""
    keep = [c for c in files.columns if c != "text"]
    rows = files.select(*keep, F.posexplode(_blocks(F.col("text"))).alias("block", "_b"))
    clock = r"(?:\d+:)?\d{2}:\d{2}\.\d{3}"
    p = rf"(?s)^(?:([^\n]*)\n)?[ \t]*({clock})[ \t]+-->[ \t]+({clock})[ \t]*([^\n]*)(?:\n(.*))?$"
    skip = F.col("_b").rlike(r"^(?:WEBVTT|NOTE|STYLE|REGION)(?:\s|$)")
    rows = rows.filter(~skip & F.col("_b").rlike(p))
    g = lambda i: F.regexp_extract("_b", p, i)
    return rows.select(
        *keep, "block", F.nullif(g(1), F.lit("")).alias("id"), _ticks(g(2)).alias("start"), _ticks(g(3)).alias("end"),
        F.nullif(strip(g(4)), F.lit("")).alias("settings"), F.regexp_replace(g(5), r"\n+$", "").alias("text"),
    )


def read_webvtt(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Cues of all ``.vtt`` files below ``path``, named and ordered as in ``read_srt``."""
    return parse_webvtt(read_blocks(spark, path, ".vtt", stream))


def webvtt_blocks(cues: DataFrame, order: list[str], bounded: bool | None = None) -> DataFrame:
    """WebVTT blocks (``media_id, cue_no, block``) of rows as ``parse_webvtt`` gives them; times come in ticks."""
    rows = number_rows(cues, ["media_id"], order, "cue_no", bounded)
    clock = lambda c: srt_time(F.col(c) / (TICKS_PER_MS * 1000), ".")
    head = F.concat(F.coalesce(F.concat("id", F.lit("\n")), F.lit("")), clock("start"), F.lit(" --> "), clock("end"), F.coalesce(F.concat(F.lit(" "), "settings"), F.lit("")))
    # A blank line would end the cue.
    return rows.select("media_id", "cue_no", F.concat(head, F.lit("\n"), F.regexp_replace("text", r"\n[ \t]*(?=\n)", ""), F.lit("\n")).alias("block"))


def write_webvtt(cues: DataFrame, path: str, order: list[str], mode: str = "append", bounded: bool | None = None) -> None:
    """One WebVTT file per media, as ``write_srt`` does it."""
    blocks = webvtt_blocks(cues, order, bounded).select("media_id", F.col("cue_no").alias("ord"), F.col("block").alias("value"))
    write_blocks(blocks, path, ".vtt", "WEBVTT\n\n", mode, bool(bounded))


def dedup_cues(cues: DataFrame) -> DataFrame:
    """Exact repeats dropped; a cue that continues one of the same text and settings extends it."""
    rows = cues.select("media_id", "id", "start", "end", "text", "settings").distinct()
    same = ["media_id", "text", "settings"]
    order = ["start", "end", "id"]
    small = fits(rows, same)
    rows = lag_lead(rows, same, order, lags={"_pe": F.col("end")}, bounded=small)
    rows = scan(rows, same, order, {"_run": run_sum(F.when(F.col("_pe") == F.col("start"), 0).otherwise(1))}, small)
    return rows.groupBy(*same, "_run").agg(F.min_by("id", F.struct(*order)).alias("id"), F.min("start").alias("start"), F.max("end").alias("end")).select(
        "media_id", "id", "start", "end", "text", "settings"
    )
