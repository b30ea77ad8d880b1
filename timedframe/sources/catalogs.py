"""Catalog-side files: URL lists, job imports, archives, HLS playlists, music folders and info records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedframe.functions.scalars import group, normalize_video_url, parse_codecs, urljoin
from timedframe.operators.ordered import number_rows
from timedframe.semantics import blank, strip

AUDIO_FILES = ["mp3", "wav", "m4a", "aac", "ogg", "flac"]


def parse_url_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """URLs of a batch file: byte-order mark and trailing comments cut, comment and blank lines dropped."""
    bare = strip(F.regexp_replace(F.col(value), "^(?:﻿|ï»¿)", ""))
    url = strip(F.regexp_replace(bare, r"(?U)\s#.*$", ""))
    keep = [c for c in lines.columns if c != value]
    return lines.select(*keep, url.alias("url"), bare.alias("_b")).filter((F.length("_b") > 0) & ~F.col("_b").rlike(r"^[#;\]]")).drop("_b")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_url_lines(spark.read.text(path))


JOB_CSV = "ordinal string, video_name string, link string"


def clean_job_rows(rows: DataFrame, order: str) -> DataFrame:
    """Imported jobs: blank rows dropped, ordinals default to the row's place, addresses normalised, no link is an error."""
    some = rows.filter(~(blank("ordinal") & blank("link") & blank("video_name")))
    some = number_rows(some, [], [order], "_place")
    link = normalize_video_url(F.coalesce("link", F.lit("")))
    out = some.select(
        order, F.coalesce(strip("ordinal").try_cast("bigint"), F.col("_place")).alias("ordinal"), strip("video_name").alias("video_name"), link.alias("link")
    )
    return out.withColumn("status", F.when(F.length("link") == 0, "error").otherwise("ready"))


def read_job_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(JOB_CSV).csv(path, header=True, quote='"', escape='"', multiLine=True)
    return clean_job_rows(rows.withColumn("row_no", F.monotonically_increasing_id()), "row_no").drop("row_no")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Recorded ``extractor id`` lines."""
    return archive_ids(spark.read.text(path))


def archive_ids(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.select(strip(F.col(value)).alias("archive_id")).filter(F.length("archive_id") > 0).distinct()


def archive_lines(entries: DataFrame, extractor: str) -> DataFrame:
    return entries.select(F.concat(F.lit(extractor.lower() + " "), F.col("id").cast("string")).alias("value"))


def append_archive(entries: DataFrame, extractor: str, path: str) -> None:
    archive_lines(entries, extractor).write.mode("append").text(path)


# ---- HLS -----------------------------------------------------------------------------------------


def _attributes(text: Column) -> Column:
    p = r"""([A-Z0-9-]+)=("[^"]*"|[^",\s][^",]*)"""
    keys = F.regexp_extract_all(text, F.lit(p), 1)
    values = F.transform(F.regexp_extract_all(text, F.lit(p), 2), lambda v: F.regexp_replace(v, '^"|"$', ""))
    return F.arrays_zip(keys.alias("k"), values.alias("v"))


def _attribute(pairs: str, name: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["k"] == name), F.lit(0))["v"]


def parse_hls(files: DataFrame) -> DataFrame:
    """Format rows of HLS master playlists (``media_id, base_url, text``): every stream entry with its address,
    and every rendition that has one; a stream whose audio group has its own address carries no audio."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    stream = r"(?m)^#EXT-X-STREAM-INF:([^\n]*)\n(?:\s*\n|#[^\n]*\n)*([^#\n][^\n]*)$"
    rows = files.select("media_id", "base_url", text.alias("text"))
    media = rows.select("media_id", "base_url", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^#EXT-X-MEDIA:([^\n]*)$"), 1)).alias("i", "_l"))
    media = media.withColumn("_a", _attributes(F.col("_l"))).filter(_attribute("_a", "URI").isNotNull() & (_attribute("_a", "TYPE").isin("AUDIO", "VIDEO")))
    renditions = media.select(
        "media_id", F.col("i").alias("entry"), F.lit("rendition").alias("kind"),
        F.concat_ws("-", _attribute("_a", "GROUP-ID"), _attribute("_a", "NAME")).alias("format_id"), urljoin(F.col("base_url"), _attribute("_a", "URI")).alias("url"),
        F.lit(None).cast("double").alias("tbr"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("fps"),
        F.when(_attribute("_a", "TYPE") == "AUDIO", "none").alias("vcodec"), F.lit(None).cast("string").alias("acodec"), _attribute("_a", "LANGUAGE").alias("language"),
        F.when(_attribute("_a", "TYPE") == "AUDIO", _attribute("_a", "GROUP-ID")).alias("audio_group_id"),
    )
    groups = renditions.filter(F.col("audio_group_id").isNotNull()).select("media_id", "audio_group_id", F.lit(True).alias("_own")).distinct()
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(stream), 1).alias("a"), F.regexp_extract_all("text", F.lit(stream), 2).alias("u"))
    streams = rows.select("media_id", "base_url", F.posexplode(found).alias("i", "_z")).withColumn("_a", _attributes(F.col("_z.a")))
    rate = F.coalesce(_attribute("_a", "AVERAGE-BANDWIDTH").try_cast("double"), _attribute("_a", "BANDWIDTH").try_cast("double")) / 1000
    size = _attribute("_a", "RESOLUTION")
    streams = streams.select(
        "media_id", F.col("i").alias("entry"), F.lit("stream").alias("kind"),
        F.coalesce(_attribute("_a", "NAME"), F.floor(rate).cast("string"), F.col("i").cast("string")).alias("format_id"),
        urljoin(F.col("base_url"), strip("_z.u")).alias("url"), rate.alias("tbr"),
        group(size, r"^(\d+)[xX](\d+)$", 1).try_cast("int").alias("width"), group(size, r"^(\d+)[xX](\d+)$", 2).try_cast("int").alias("height"),
        _attribute("_a", "FRAME-RATE").try_cast("double").alias("fps"), parse_codecs(_attribute("_a", "CODECS")).alias("_c"),
        F.lit(None).cast("string").alias("language"), _attribute("_a", "AUDIO").alias("audio_group_id"),
    )
    streams = streams.join(groups, ["media_id", "audio_group_id"], "left")
    quiet = F.col("_own") & F.coalesce(F.col("_c.vcodec") != "none", F.lit(True))
    streams = streams.withColumns({"vcodec": F.col("_c.vcodec"), "acodec": F.when(quiet, "none").otherwise(F.col("_c.acodec"))})
    return streams.select(*renditions.columns).unionByName(renditions)


def read_hls_catalog(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.m3u8)?$", 1)
    return parse_hls(files.select(name.alias("media_id"), F.lit(base_url).alias("base_url"), F.col("value").alias("text")))


def hls_vod_duration(lines: DataFrame) -> DataFrame:
    """Whole seconds of finished playlists (``media_id, value``); live or empty ones have none."""
    seconds = group(F.col("value"), r"^#EXTINF:\s*([0-9.]+)", 1).try_cast("double")
    agg = lines.groupBy("media_id").agg(F.sum(seconds).alias("_s"), F.bool_or(F.startswith("value", F.lit("#EXT-X-ENDLIST"))).alias("_end"))
    return agg.select("media_id", F.when(F.col("_end"), F.nullif(F.floor(F.coalesce("_s", F.lit(0.0))).cast("bigint"), F.lit(0))).alias("duration"))


# ---- music and info records ----------------------------------------------------------------------


def tracks_of(files: DataFrame, root: str) -> DataFrame:
    """Project, track, extension and size of audio files (``path, length``); files at the root have no project."""
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/+", "")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    project = F.nullif(F.regexp_extract(rel, r"^([^/]+)/[^/]+$", 1), F.lit(""))
    rows = files.select(project.alias("project"), F.regexp_extract(rel, r"([^/]+)$", 1).alias("track"), ext.alias("ext"), F.col("length").alias("size"))
    return rows.filter(F.col("ext").isin(AUDIO_FILES))


def list_tracks(spark: SparkSession, root: str) -> DataFrame:
    """Listing of a music folder; only file metadata is read, never content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return tracks_of(files, root)


def info_records(media: DataFrame) -> DataFrame:
    """Media rows as JSON texts without private fields and unknown values."""
    public = [c for c in media.columns if not c.startswith("_")]
    return media.select(F.to_json(F.struct(*public), {"ignoreNullFields": "true"}).alias("value"))


def write_info_json(media: DataFrame, path: str) -> None:
    info_records(media).write.mode("errorifexists").text(path)
