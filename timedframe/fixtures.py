"""Reference-shaped tables derived from the given parquet tables, as DataFrames and as oracle CTEs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedframe.operators.ordered import input_bytes, number_rows
from timedframe.operators.segments import estimate_timeline
from timedframe.semantics import strip

TODAY = "2024-06-30"
#: Stored bytes of a text table per task.
TEXT_TASK_BYTES = 8 << 20

STATUS = {"signup": "pending", "view": "started", "click": "started", "purchase": "finished", "error": "failed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; zone-less timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A text table spread by key over the cores, and over more tasks as it grows, when it comes in fewer files than that.

    A single small file is one task, however heavy its expressions; a table of many files is left alone.
    Later steps by the same key stay in these tasks, so a task's share is bounded.
    """
    df = table(spark, sf_dir, name)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(input_bytes(df) / TEXT_TASK_BYTES))
    return df.repartition(tasks, key) if len(df.inputFiles()) < tasks else df


def status_of(event_type):
    out = None
    for k, v in STATUS.items():
        out = F.when(event_type == k, v) if out is None else out.when(event_type == k, v)
    return out


# ---- documents -----------------------------------------------------------------------------------


def doc_lines(spark, sf):
    """One row per non-blank line; ``seg_id`` is the line's ordinal in its document."""
    return (
        text_table(spark, sf, "documents", "doc_id")
        .select(F.col("doc_id").alias("media_id"), F.col("lang").alias("language"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .select("media_id", "language", (F.col("pos") + 1).alias("seg_id"), strip("raw").alias("text"))
        .filter(F.length("text") > 0)
    )


def doc_segments(spark, sf):
    """Document lines with a reading-time timeline; a document is one cell, so its group is bounded."""
    return estimate_timeline(doc_lines(spark, sf), bounded=True)


# ---- conversations -------------------------------------------------------------------------------


def conv_segments(spark, sf):
    base = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("media_id"),
        F.col("turn").alias("seg_id"),
        F.when(F.col("role") == "system", "narrator").otherwise(F.col("role")).alias("speaker"),
        F.col("text"),
    )
    return estimate_timeline(base)


def conv_windows(spark, sf):
    return (
        conv_segments(spark, sf)
        .filter(F.col("seg_id") % 2 == 0)
        .select("media_id", "seg_id", (F.col("start") + 0.5).alias("start"), (F.col("end") + 0.5).alias("end"))
    )


def conv_revisions(spark, sf):
    return (
        table(spark, sf, "conversations")
        .filter(F.col("turn") % 3 == 0)
        .select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_id"), F.upper("text").alias("text"))
    )


# ---- events --------------------------------------------------------------------------------------


def job_events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("job_id"),
        status_of(F.col("event_type")).alias("status"),
        F.col("event_type").alias("stage"),
        F.col("value").alias("elapsed_s"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def ev_intervals(spark, sf):
    """Per user: event time since the user's first event in whole microseconds, lasting ``value`` seconds."""
    ev = table(spark, sf, "events")
    t0 = ev.groupBy("user_id").agg(F.min("ts").alias("t0"))
    start = F.unix_micros("ts") - F.unix_micros("t0")
    end = start + F.round(F.col("value") * 1000000).cast("bigint")
    return ev.join(t0, "user_id").select(
        F.col("user_id").alias("media_id"),
        "event_id",
        (start / F.lit(1000000.0)).alias("start_time"),
        (end / F.lit(1000000.0)).alias("end_time"),
        F.col("event_type").alias("category"),
        F.col("event_type").alias("title"),
        start.alias("start_us"),
        end.alias("end_us"),
    )


def ev_signal(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("series_id"), "ts", "event_id", "value")
    return number_rows(ev, ["series_id"], ["ts", "event_id"], "t_idx").select("series_id", "t_idx", "value")


# ---- orders --------------------------------------------------------------------------------------


def ord_entries(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("playlist_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderdate").cast("date").alias("upload_date"),
        F.floor("o_totalprice").alias("view_count"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 21).cast("int")).alias("age_limit"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 1000).alias("duration"),
        F.col("o_orderstatus").alias("status"),
    )
    return number_rows(o, ["playlist_id"], ["upload_date", "id"], "playlist_index")


def ord_archive(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    return o.select(F.concat(F.lit("orders "), F.col("o_orderkey").cast("string")).alias("archive_id"))


# ---- part ----------------------------------------------------------------------------------------


def part_formats(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        F.col("p_brand").alias("media_id"),
        k.alias("part_id"),
        F.regexp_replace("p_name", " ", "_").alias("format_id"),
        F.when(k % 3 == 0, "mp4").when(k % 3 == 1, "webm").otherwise("m4a").alias("ext"),
        F.when(k % 3 == 2, "none").when(k % 5 == 0, "avc1.64").when(k % 5 == 1, "vp9").when(k % 5 == 2, "av01.0").alias("vcodec"),
        F.when(k % 4 == 1, "none").when(k % 3 == 0, "mp4a.40.2").otherwise("opus").alias("acodec"),
        F.when(k % 3 != 2, F.col("p_size") * 36).alias("height"),
        F.when(k % 3 != 2, F.col("p_size") * 64).alias("width"),
        F.when(k % 6 != 0, F.lit(25.0) + (k % 3)).alias("fps"),
        F.col("p_retailprice").alias("tbr"),
        F.when(k % 8 != 0, (F.col("p_retailprice") * 1000).cast("bigint")).alias("filesize"),
        F.concat(F.lit("https://cdn.example/"), (k / 2).cast("bigint").cast("string")).alias("url"),
        F.when(k % 9 == 0, F.lit("true")).when(k % 9 == 1, F.lit("maybe")).alias("has_drm"),
    )
    return number_rows(p, ["media_id"], ["part_id"], "format_idx")


# ---- oracle CTEs ---------------------------------------------------------------------------------

WS = r"[\s\x0B\x{85}\p{Z}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


_TIMELINE = """SELECT *, round_even(e0 - d0, 2) AS start, round_even(e0, 2) AS "end" FROM (
  SELECT *, sum(d0) OVER (PARTITION BY media_id ORDER BY seg_id) AS e0
  FROM (SELECT *, greatest(1.0::DOUBLE, length(text) / 14.0::DOUBLE) AS d0 FROM {src}))"""

CTES = {
    "doc_lines": f"""SELECT media_id, language, seg_id, text FROM (
  SELECT doc_id AS media_id, lang AS language, seg_id, {sql_strip("raw")} AS text FROM (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw,
           unnest(range(1, len(string_split(text, chr(10))) + 1)) AS seg_id FROM documents)) WHERE text <> ''""",
    "doc_segments": _TIMELINE.format(src="doc_lines"),
    "conv_base": """SELECT conv_id AS media_id, turn AS seg_id,
  CASE WHEN role = 'system' THEN 'narrator' ELSE role END AS speaker, text FROM conversations""",
    "conv_segments": _TIMELINE.format(src="conv_base"),
    "conv_windows": """SELECT media_id, seg_id, start + 0.5 AS start, "end" + 0.5 AS "end" FROM conv_segments WHERE seg_id % 2 = 0""",
    "conv_revisions": "SELECT conv_id AS media_id, turn AS seg_id, upper(text) AS text FROM conversations WHERE turn % 3 = 0",
    "job_events": """SELECT event_id, ts, user_id AS job_id,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'started' WHEN 'click' THEN 'started'
       WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' END AS status,
  event_type AS stage, value AS elapsed_s, (props->>'$.k')::BIGINT AS k FROM events""",
    "ev_intervals": """SELECT media_id, event_id, s / 1000000.0::DOUBLE AS start_time,
  (s + round(value * 1000000)::BIGINT) / 1000000.0::DOUBLE AS end_time, category, category AS title, s AS start_us,
  s + round(value * 1000000)::BIGINT AS end_us
  FROM (SELECT user_id AS media_id, event_id, value, event_type AS category,
        epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS s FROM events)""",
    "ev_signal": """SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t_idx, value FROM events""",
    "ord_entries": """SELECT o_custkey AS playlist_id, o_orderkey AS id, o_orderpriority AS title, o_orderdate::DATE AS upload_date,
  floor(o_totalprice)::BIGINT AS view_count, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 21)::INT END AS age_limit,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 END AS duration, o_orderstatus AS status,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS playlist_index FROM orders""",
    "ord_archive": "SELECT 'orders ' || o_orderkey AS archive_id FROM orders WHERE o_orderstatus = 'F'",
    "part_formats": """SELECT p_brand AS media_id, p_partkey AS part_id, replace(p_name, ' ', '_') AS format_id,
  CASE p_partkey % 3 WHEN 0 THEN 'mp4' WHEN 1 THEN 'webm' ELSE 'm4a' END AS ext,
  CASE WHEN p_partkey % 3 = 2 THEN 'none' WHEN p_partkey % 5 = 0 THEN 'avc1.64' WHEN p_partkey % 5 = 1 THEN 'vp9' WHEN p_partkey % 5 = 2 THEN 'av01.0' END AS vcodec,
  CASE WHEN p_partkey % 4 = 1 THEN 'none' WHEN p_partkey % 3 = 0 THEN 'mp4a.40.2' ELSE 'opus' END AS acodec,
  CASE WHEN p_partkey % 3 <> 2 THEN p_size * 36 END AS height, CASE WHEN p_partkey % 3 <> 2 THEN p_size * 64 END AS width,
  CASE WHEN p_partkey % 6 <> 0 THEN 25.0::DOUBLE + (p_partkey % 3) END AS fps, p_retailprice AS tbr,
  CASE WHEN p_partkey % 8 <> 0 THEN trunc(p_retailprice * 1000)::BIGINT END AS filesize,
  'https://cdn.example/' || (p_partkey // 2) AS url,
  CASE WHEN p_partkey % 9 = 0 THEN 'true' WHEN p_partkey % 9 = 1 THEN 'maybe' END AS has_drm,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS format_idx FROM part""",
}

NEEDS = {
    "doc_segments": ["doc_lines"],
    "conv_segments": ["conv_base"],
    "conv_windows": ["conv_base", "conv_segments"],
}


def oracle(ctes: str, body: str) -> str:
    """``WITH`` clause over the named fixtures (space separated), then ``body`` (which may add CTEs after a comma)."""
    names: list[str] = []
    for c in ctes.split():
        for d in [*NEEDS.get(c, []), c]:
            if d not in names:
                names.append(d)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"WITH {head}{body if body.lstrip().startswith(',') else chr(10) + body}"
