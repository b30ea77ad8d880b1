"""Checked queries over readers and writers.  File texts are written by Spark from the given tables."""

import uuid

from pyspark.sql import functions as F

from timedframe import fixtures as fx
from timedframe.fixtures import oracle
from timedframe.operators.ordered import number_rows, shared_folder
from timedframe.registry.core import query
from timedframe.semantics import r4
from timedframe.sources import captions as cap
from timedframe.sources import catalogs as cat
from timedframe.sources import logs
from timedframe.sources import transcripts as tr


def fresh_folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def conv_documents(spark, sf, part_rows=3):
    seg = fx.conv_segments(spark, sf)
    media = seg.groupBy("media_id").agg(F.lit("en").alias("language"), F.max("end").alias("duration_s"))
    return seg, media, tr.transcript_documents(seg, media, part_rows)


@query("io1_read_transcripts", oracle("conv_segments", 'SELECT media_id::VARCHAR AS media_id, seg_id, speaker, round(start, 4) AS start, round("end", 4) AS "end", text FROM conv_segments'))
def _(spark, sf):
    seg, media, _ = conv_documents(spark, sf)
    path = fresh_folder(spark, "transcripts")
    tr.write_transcripts(seg, media, path, 3)
    _, back = tr.read_transcripts(spark, path, lines=True)
    return back.select("media_id", F.col("seg_id").cast("bigint").alias("seg_id"), "speaker", r4("start").alias("start"), r4("end").alias("end"), "text")


@query(
    "io2_transcript_documents",
    oracle("conv_segments", """, r AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY seg_id) - 1) // 3 AS part FROM conv_segments)
SELECT media_id, part::INT AS part, string_agg(seg_id || ':' || text, '|' ORDER BY seg_id) AS body FROM r GROUP BY ALL"""),
)
def _(spark, sf):
    docs = conv_documents(spark, sf)[2]
    body = F.array_join(F.transform("segments", lambda s: F.concat(s["id"].cast("string"), F.lit(":"), s["text"])), "|")
    return docs.select("media_id", "part", body.alias("body"))


def responses(spark, sf):
    seg = fx.conv_segments(spark, sf).withColumn("t", F.when(F.col("seg_id") % 4 == 3, "  ").otherwise(F.concat(F.lit(" "), "text")))
    said = F.array_sort(F.collect_list(F.struct("seg_id", F.col("t").alias("transcript"), (F.col("start") + 0.001).alias("start"), (F.col("end") + 0.001).alias("end"))))
    return seg.groupBy("media_id").agg(said.alias("_s")).select("media_id", F.col("_s").alias("s")).select(
        "media_id",
        F.struct(
            F.struct(F.transform("s", lambda u: F.struct(u["transcript"].alias("transcript"), u["start"].alias("start"), u["end"].alias("end"))).alias("utterances")).alias("results"),
            F.struct(F.when(F.col("media_id") % 2 == 0, 99.5).alias("duration")).alias("metadata"),
        ).alias("response"),
    )


IDX_SQL = ", i AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_id) - 1 AS idx FROM conv_segments)"


@query("io3_segments_from_utterances", oracle("conv_segments", IDX_SQL + ' SELECT media_id, idx AS seg_id, round(start, 2) AS start, round("end", 2) AS "end", text FROM i WHERE seg_id % 4 <> 3'))
def _(spark, sf):
    out = tr.segments_from_utterances(responses(spark, sf))
    return out.select("media_id", F.col("seg_id").cast("bigint").alias("seg_id"), F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "text")


@query("io3_utterance_durations", oracle("conv_segments", """SELECT media_id, CASE WHEN media_id % 2 = 0 THEN 99.5 ELSE round(coalesce(max("end") FILTER (seg_id % 4 <> 3), 0), 2) END AS duration_s FROM conv_segments GROUP BY media_id"""))
def _(spark, sf):
    return tr.utterance_durations(responses(spark, sf)).select("media_id", F.round("duration_s", 2).alias("duration_s"))


@query("io4_parse_url_lines", "SELECT page_id, url FROM pages WHERE page_id % 5 <> 0")
def _(spark, sf):
    k = F.col("page_id")
    line = F.when(k % 5 == 0, F.concat(F.lit(" ; "), "url")).when(k % 5 == 1, F.concat(F.lit("﻿  "), "url")).when(k % 5 == 2, F.concat("url", F.lit("  # later"))).otherwise(F.col("url"))
    return cat.parse_url_lines(fx.table(spark, sf, "pages").select("page_id", line.alias("value")))


@query(
    "io5_clean_job_rows",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY page_id) AS place FROM pages WHERE page_id % 7 <> 0)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id + 100 ELSE place END AS ordinal, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://www.douyin.com/video/' || page_id ELSE url END AS link, CASE page_id % 4 WHEN 0 THEN 'error' ELSE 'ready' END AS status FROM r""",
)
def _(spark, sf):
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    gone = k % 7 == 0
    rows = fx.table(spark, sf, "pages").select(
        "page_id",
        F.when(gone, " ").when(k % 3 == 0, F.concat(F.lit(" "), (k + 100).cast("string"))).otherwise("").alias("ordinal"),
        F.when(gone, "").otherwise(F.concat(F.lit("clip"), n)).alias("video_name"),
        F.when(gone | (k % 4 == 0), " ").when(k % 4 == 1, F.concat(F.lit("https://douyin.com/x?modal_id="), n)).otherwise(F.col("url")).alias("link"),
    )
    return cat.clean_job_rows(rows, "page_id").select("page_id", "ordinal", "link", "status")


@query("io6_write_read_events", "SELECT event_id::VARCHAR AS job_id, event_type AS event, round(epoch_us(ts) / 1000000.0::DOUBLE, 2) AS ts, 'editor' AS service FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select("ts", F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("job_id"), F.col("props").alias("payload"))
    path = fresh_folder(spark, "events")
    logs.write_events(ev, path, "editor")
    return logs.read_events(spark, path, "2024-01-20").select("job_id", "event", F.round("ts", 2).alias("ts"), "service")


def srt_files(spark, sf):
    """SRT texts per document, written by the SRT writer's own blocks."""
    cues = fx.doc_segments(spark, sf).select("media_id", "seg_id", "start", "end", F.col("text").alias("line"))
    blocks = cap.srt_blocks(cues, ["seg_id"], bounded=True)
    return blocks.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", "block"))), lambda b: b["block"]), "\n").alias("text"))


@query("io8_parse_srt", oracle("doc_segments", 'SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_id) - 1 AS block, round(start, 4) AS start, round("end", 4) AS "end", text FROM doc_segments'))
def _(spark, sf):
    return cap.parse_srt(srt_files(spark, sf)).select("media_id", F.col("block").cast("bigint").alias("block"), r4("start").alias("start"), r4("end").alias("end"), "text")


@query(
    "io9_srt_blocks",
    oracle("doc_segments", """, m AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_id) AS n, round_even(start * 1000, 0)::BIGINT AS a, round_even("end" * 1000, 0)::BIGINT AS b FROM doc_segments)
SELECT media_id, n AS cue_no, n || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10) AS block FROM m"""),
)
def _(spark, sf):
    cues = fx.doc_segments(spark, sf).select("media_id", "seg_id", "start", "end", F.col("text").alias("line"))
    return cap.srt_blocks(cues, ["seg_id"], bounded=True)


#: Half of the documents in one folder and half in another, with the same file names in both.
FOLDERED = "CASE WHEN media_id % 2 = 0 THEN 'even/' ELSE 'odd/' END || (media_id // 2)"


def foldered(seg):
    k = F.col("media_id")
    return seg.withColumn("media_id", F.concat(F.when(k % 2 == 0, "even/").otherwise("odd/"), F.expr("media_id div 2").cast("string")))


@query(
    "io9_srt_files",
    oracle("doc_segments", f"""SELECT {FOLDERED} AS media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_id) AS cue_no, round(start, 4) AS start, round("end", 4) AS "end", text FROM doc_segments"""),
)
def _(spark, sf):
    cues = foldered(fx.doc_segments(spark, sf)).select("media_id", "seg_id", "start", "end", F.col("text").alias("line"))
    path = fresh_folder(spark, "srt")
    cap.write_srt(cues, path, ["seg_id"], bounded=True)  # a document is one cell
    back = number_rows(cap.read_srt(spark, path), ["media_id"], ["part", "at", "block"], "cue_no", bounded=True)
    return back.select("media_id", "cue_no", r4("start").alias("start"), r4("end").alias("end"), "text")


@query(
    "io10_webvtt_files",
    oracle("doc_segments", f"""SELECT {FOLDERED} AS media_id, CASE WHEN seg_id % 2 = 0 THEN 'c' || seg_id END AS id, round_even(start * 1000, 0)::BIGINT * 90 AS start, round_even("end" * 1000, 0)::BIGINT * 90 AS "end", CASE WHEN seg_id % 3 = 0 THEN 'align:start' END AS settings, text || chr(10) || 'two' AS text FROM doc_segments"""),
)
def _(spark, sf):
    s, ticks = F.col("seg_id"), lambda c: F.bround(F.col(c) * 1000).cast("bigint") * cap.TICKS_PER_MS
    cues = foldered(fx.doc_segments(spark, sf)).select(
        "media_id", "seg_id", F.when(s % 2 == 0, F.concat(F.lit("c"), s.cast("string"))).alias("id"), ticks("start").alias("start"), ticks("end").alias("end"),
        F.when(s % 3 == 0, "align:start").alias("settings"), F.concat("text", F.lit("\n\ntwo")).alias("text"),
    )
    path = fresh_folder(spark, "vtt")
    cap.write_webvtt(cues, path, ["seg_id"], bounded=True)  # a document is one cell
    return cap.read_webvtt(spark, path).select("media_id", "id", "start", "end", "settings", "text")


@query(
    "io10_parse_webvtt",
    oracle("doc_segments", """SELECT media_id, CASE WHEN seg_id % 2 = 0 THEN 'c' || seg_id END AS id, round_even(start * 1000, 0)::BIGINT * 90 AS start, round_even("end" * 1000, 0)::BIGINT * 90 AS "end", CASE WHEN seg_id % 3 = 0 THEN 'align:start' END AS settings, text || chr(10) || 'two' AS text FROM doc_segments"""),
)
def _(spark, sf):
    from timedframe.functions.scalars import srt_time

    s = F.col("seg_id")
    block = F.concat(
        F.when(s % 2 == 0, F.concat(F.lit("c"), s.cast("string"), F.lit("\n"))).otherwise(""), srt_time(F.col("start"), "."), F.lit(" --> "), srt_time(F.col("end"), "."),
        F.when(s % 3 == 0, " align:start").otherwise(""), F.lit("\n"), F.col("text"), F.lit("\ntwo\n"),
    )
    seg = fx.doc_segments(spark, sf).withColumn("b", block)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "b"))), lambda x: x["b"]), "\n")
    files = seg.groupBy("media_id").agg(F.concat(F.lit("WEBVTT\nX-TIMESTAMP-MAP=LOCAL:0\n\nNOTE made here\n\n"), body).alias("text"))
    return cap.parse_webvtt(files).select("media_id", "id", "start", "end", "settings", "text")


@query(
    "io11_parse_hls",
    oracle("part_formats", """, s AS (SELECT *, CASE WHEN part_id % 2 = 0 THEN 'n' || part_id ELSE floor(tbr)::INT::VARCHAR END AS fid FROM part_formats)
SELECT media_id, 'stream' AS kind, fid AS format_id, 'https://h.example/a/v' || part_id || '.m3u8' AS url, round(floor(tbr * 1000) / 1000, 4) AS tbr, CASE WHEN height IS NOT NULL THEN width END AS width, CASE WHEN width IS NOT NULL THEN height END AS height, 'avc1.4d' AS vcodec, CASE WHEN part_id % 3 = 0 THEN 'none' ELSE 'mp4a.40.2' END AS acodec FROM s
UNION ALL SELECT media_id, 'rendition', 'aud-English', 'https://h.example/eng.m3u8', NULL, NULL::INT, NULL::INT, 'none', NULL FROM (SELECT DISTINCT media_id, format_idx // 500 FROM part_formats)"""),
)
def _(spark, sf):
    k, n = F.col("part_id"), F.col("part_id").cast("string")
    # A playlist of at most 500 streams each, so a brand of any size stays in bounded cells.
    s = fx.part_formats(spark, sf).withColumn("piece", F.expr("format_idx div 500"))
    size = F.concat(F.lit(",RESOLUTION="), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    line = F.concat(
        F.lit("#EXT-X-STREAM-INF:BANDWIDTH=9,AVERAGE-BANDWIDTH="), F.floor(F.col("tbr") * 1000).cast("string"), F.coalesce(size, F.lit("")),
        F.lit(',CODECS="avc1.4d,mp4a.40.2"'), F.when(k % 2 == 0, F.concat(F.lit(',NAME="n'), n, F.lit('"'))).otherwise(""), F.when(k % 3 == 0, ',AUDIO="aud"').otherwise(',AUDIO="none"'),
        F.lit("\n#EXT-X-NOTE\n\nv"), n, F.lit(".m3u8\n"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("format_idx", line.alias("l")))), lambda x: x["l"]), "")
    head = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud",NAME="English",LANGUAGE="en",URI="/eng.m3u8"\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="none",NAME="Muxed"\n'
    files = s.groupBy("media_id", "piece").agg(F.concat(F.lit(head), body).alias("text")).drop("piece").withColumn("base_url", F.lit("https://h.example/a/master.m3u8"))
    return cat.parse_hls(files).select("media_id", "kind", "format_id", "url", r4("tbr").alias("tbr"), "width", "height", "vcodec", "acodec")


@query(
    "io12_hls_vod_duration",
    "SELECT user_id AS media_id, CASE WHEN bool_or(event_type = 'signup') THEN nullif(floor(sum(value) FILTER (event_type <> 'signup') + 0.001)::BIGINT, 0) END AS duration FROM events GROUP BY user_id",
)
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    first = F.concat(F.lit("#EXTINF:"), F.abs(F.col("value")).cast("decimal(12,3)").cast("string"), F.lit(",t"))
    lines = e.select(F.col("user_id").alias("media_id"), F.when(F.col("event_type") == "signup", "#EXT-X-ENDLIST").otherwise(first).alias("value"))
    extra = e.groupBy(F.col("user_id").alias("media_id")).agg(F.lit("#EXTINF:0.001,").alias("value"))
    return cat.hls_vod_duration(lines.unionByName(extra))


@query("io13_archive", oracle("ord_entries", "SELECT DISTINCT 'orders ' || id AS archive_id FROM ord_entries WHERE status = 'F'"))
def _(spark, sf):
    done = fx.ord_entries(spark, sf).filter(F.col("status") == "F")
    path = fresh_folder(spark, "archive")
    cat.append_archive(done, "Orders", path)
    return cat.read_archive(spark, path)


@query("io14_parse_corpus", oracle("doc_lines", "SELECT media_id || '_' || seg_id AS filename, text, CASE WHEN seg_id % 2 = 0 THEN '1,' || seg_id END AS codes FROM doc_lines"))
def _(spark, sf):
    d = fx.doc_lines(spark, sf).select(
        F.concat_ws("_", F.col("media_id").cast("string"), F.col("seg_id").cast("string")).alias("filename"), "text", F.when(F.col("seg_id") % 2 == 0, F.array(F.lit(1), F.col("seg_id").cast("int"))).alias("codes")
    )
    short = d.select(F.concat(F.lit("x"), "filename").alias("value"))
    out = tr.parse_corpus(tr.corpus_lines(d).unionByName(short))
    return out.select("filename", "text", F.when(F.col("codes").isNotNull(), F.array_join(F.transform("codes", lambda c: c.cast("string")), ",")).alias("codes"))


@query(
    "io15_tracks",
    "SELECT CASE WHEN p_partkey % 6 <> 0 THEN p_brand END AS project, p_partkey || '.MP3' AS track, 'mp3' AS ext, p_partkey * 10 AS size FROM part WHERE p_partkey % 4 <> 0",
)
def _(spark, sf):
    k = F.col("p_partkey")
    path = F.concat(F.lit("file:/data/music/"), F.when(k % 6 != 0, F.concat("p_brand", F.lit("/"))).otherwise(""), k.cast("string"), F.when(k % 4 == 0, ".txt").otherwise(".MP3"))
    return cat.tracks_of(fx.table(spark, sf, "part").select(path.alias("path"), (k * 10).alias("length")), "/data/music")


@query("io16_info_records", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '{\"id\":' || p_partkey || ',\"title\":\"' || p_name || '\"}' ELSE '{\"id\":' || p_partkey || '}' END AS value FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    m = fx.table(spark, sf, "part").select(k.alias("id"), F.when(k % 2 == 0, F.col("p_name")).alias("title"), F.lit("x").alias("_private"), F.lit(1).alias("__key"))
    return cat.info_records(m).select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), "value")


@query(
    "st8_dedup_cues",
    oracle("doc_segments", """, c AS (SELECT DISTINCT media_id, 't' || (seg_id // 3 % 2) AS text, round(start * 100)::BIGINT AS s, round("end" * 100)::BIGINT AS e FROM doc_segments),
f AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY media_id, text ORDER BY s, e) = s THEN 0 ELSE 1 END AS fresh FROM c), r AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id, text ORDER BY s, e) AS run FROM f)
SELECT media_id, text, min(s) AS start, max(e) AS "end" FROM r GROUP BY media_id, text, run"""),
)
def _(spark, sf):
    s = F.col("seg_id")
    seg = fx.doc_segments(spark, sf).select(
        "media_id", F.lit(None).cast("string").alias("id"), F.round(F.col("start") * 100).cast("bigint").alias("start"), F.round(F.col("end") * 100).cast("bigint").alias("end"),
        F.concat(F.lit("t"), (F.floor(s / 3) % 2).cast("string")).alias("text"), F.lit("").alias("settings"),
    )
    return cap.dedup_cues(seg.unionByName(seg)).select("media_id", "text", "start", "end")
