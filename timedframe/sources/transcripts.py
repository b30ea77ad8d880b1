"""Transcript documents, speech-recognition responses and speech-corpus files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedframe.operators.ordered import number_rows
from timedframe.schemas import TRANSCRIPT
from timedframe.semantics import r2, strip
from timedframe.sources.files import relative_id

PART_ROWS = 10_000
SEGMENT_FIELDS = ["start", "end", "text", "text_original", "speaker", "residual_risk", "words"]


def read_transcripts(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(media, segments) of JSON documents; a document without segments is an error when it is read.

    One document per file, or one per line (``lines``, as the writer leaves them).  ``media_id`` comes from
    the document or, when it has none, from the file's path below ``path``.
    """
    docs = spark.read.schema(TRANSCRIPT).option("multiLine", not lines).json(path)
    return split_transcripts(docs.withColumn("media_id", F.coalesce("media_id", relative_id(path, ".json"))))


def split_transcripts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    full = F.when(F.coalesce(F.size("segments"), F.lit(0)) > 0, F.col("segments")).otherwise(
        F.raise_error(F.concat(F.lit("transcript without segments: "), F.col("media_id").cast("string"))).cast(docs.schema["segments"].dataType)
    )
    media = docs.groupBy("media_id").agg(F.first("language").alias("language"), F.max("duration_s").alias("duration_s"))
    rows = docs.select("media_id", F.explode(full).alias("s"))
    return media, rows.select("media_id", F.col("s.id").alias("seg_id"), *[F.col(f"s.{f}").alias(f) for f in SEGMENT_FIELDS])


def transcript_documents(segments: DataFrame, media: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One document per media with its segments in order; a media past ``part_rows`` gets numbered parts,
    so that no cell and no task ever holds an unbounded transcript.  The reader joins parts again."""
    fields = [f for f in SEGMENT_FIELDS if f in segments.columns]
    rows = number_rows(segments, ["media_id"], ["seg_id"], "_rn")
    rows = rows.withColumn("part", F.floor((F.col("_rn") - 1) / part_rows).cast("int"))
    body = F.array_sort(F.collect_list(F.struct(F.col("seg_id").alias("id"), *fields)))
    return rows.groupBy("media_id", "part").agg(body.alias("segments")).join(media.select("media_id", "language", "duration_s"), "media_id", "left")


def write_transcripts(segments: DataFrame, media: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    transcript_documents(segments, media, part_rows).write.mode("errorifexists").json(path)


def segments_from_utterances(df: DataFrame, response: str = "response") -> DataFrame:
    """Segments of recognition responses: the utterance's index is the id, blank ones leave a gap, times to 0.01 s."""
    said = F.col(f"{response}.results.utterances")
    some = F.when(F.coalesce(F.size(said), F.lit(0)) > 0, said).otherwise(
        F.raise_error(F.lit("response without utterances")).cast(df.select(said).schema[0].dataType)
    )
    rows = df.select("media_id", F.posexplode(some).alias("seg_id", "u"))
    rows = rows.select("media_id", "seg_id", r2("u.start").alias("start"), r2("u.end").alias("end"), strip("u.transcript").alias("text"))
    return rows.filter(F.length("text") > 0)


def utterance_durations(df: DataFrame, response: str = "response") -> DataFrame:
    """Media duration from the response, else the end of its last spoken segment."""
    spoken = F.filter(F.col(f"{response}.results.utterances"), lambda u: F.length(strip(u["transcript"])) > 0)
    last = F.bround(F.element_at(spoken, -1)["end"], 2)
    return df.select("media_id", F.coalesce(F.col(f"{response}.metadata.duration"), F.when(F.size(spoken) > 0, last), F.lit(0.0)).alias("duration_s"))


#: What the last part of a corpus line holds if it isn't text: whole numbers in brackets, or nothing.
CODES_PART = r"^(\[[0-9,\s-]*\])?$"


def parse_corpus(lines: DataFrame, value: str = "value") -> DataFrame:
    """``file|text[|codes]`` lines; the text may hold bars.  Lines without a bar are dropped."""
    line = strip(F.col(value))
    keep = [c for c in lines.columns if c != value]
    # Exploded from one cell, so that the filter stays behind it: pushed below, it would make and split every line a second time.
    rows = lines.select(*keep, F.explode_outer(F.array(F.split(line, r"\|"))).alias("_p")).filter(F.size("_p") >= 2)
    last = F.element_at("_p", -1)
    rows = rows.withColumn("_coded", (F.size("_p") > 2) & last.rlike(CODES_PART))
    coded = F.col("_coded")
    text = F.array_join(F.slice("_p", 2, F.when(coded, F.size("_p") - 2).otherwise(F.size("_p") - 1)), "|")
    codes = F.from_json(F.when(coded & (last != ""), last), "array<int>")
    return rows.select(*keep, F.get("_p", F.lit(0)).alias("filename"), text.alias("text"), codes.alias("codes"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return parse_corpus(spark.read.text(path))


def corpus_lines(df: DataFrame) -> DataFrame:
    """One line per row.  A text without codes that ends as if it had some is followed by an empty last part."""
    alike = F.when(F.contains("text", F.lit("|")) & F.element_at(F.split("text", r"\|"), -1).rlike(CODES_PART), "")
    codes = F.when(F.col("codes").isNotNull(), F.to_json("codes")).otherwise(alike) if "codes" in df.columns else alike
    return df.select(F.concat_ws("|", "filename", "text", codes).alias("value"))


def write_corpus(df: DataFrame, path: str) -> None:
    corpus_lines(df).write.mode("errorifexists").text(path)
