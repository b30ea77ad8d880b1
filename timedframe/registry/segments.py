"""Checked queries over segment operators."""

from pyspark.sql import functions as F

from timedframe import fixtures as fx
from timedframe.fixtures import oracle, sql_strip
from timedframe.operators import segments as sg
from timedframe.registry.core import query
from timedframe.semantics import r4


def spoken(spark, sf):
    return fx.doc_segments(spark, sf).withColumn("dur", F.length("text") / F.lit(11.0))


def skip_doc():
    """Gate used with the placement query: implausible audio or text that starts with a capital E."""
    return F.col("text").startswith("E")


PLACED_SQL = """,
base AS (SELECT *, length(text) / 11.0::DOUBLE AS dur, starts_with(text, 'E') AS skipped,
  round_even(start * 22050, 0)::BIGINT AS nat, round_even(length(text) / 11.0::DOUBLE * 22050, 0)::BIGINT AS len FROM doc_segments),
summed AS (SELECT *, sum(CASE WHEN skipped THEN 0 ELSE len END) OVER w AS s FROM base WINDOW w AS (PARTITION BY media_id ORDER BY seg_id)),
led AS (SELECT *, max(CASE WHEN NOT skipped THEN nat - (s - len) END) OVER (PARTITION BY media_id ORDER BY seg_id) AS lead_s FROM summed),
placed AS (SELECT *, (s + greatest(lead_s, 0))::BIGINT AS e_s FROM led),
cascaded AS (SELECT media_id, seg_id, skipped, text, dur, start, "end", language,
  e_s, CASE WHEN skipped THEN start ELSE round_even((e_s - len) / 22050.0::DOUBLE, 3) END AS placed_start,
  CASE WHEN skipped THEN "end" ELSE round_even(e_s / 22050.0::DOUBLE, 3) END AS placed_end,
  CASE WHEN NOT skipped THEN round_even((e_s - len - nat) / 22050.0::DOUBLE, 2) END AS drift_s,
  CASE WHEN NOT skipped THEN round_even(greatest(0.0::DOUBLE, round_even(len / 22050.0::DOUBLE, 2) - round_even("end" - start, 2)), 2) END AS overrun_s
  FROM placed)"""


def placed(spark, sf):
    return sg.cascade(spoken(spark, sf), rate=22050, skip=skip_doc(), bounded=True)


@query("wn1_estimate_timeline", oracle("doc_segments", 'SELECT media_id, seg_id, round(start, 4) + 0.0 AS start, round("end", 4) + 0.0 AS "end" FROM doc_segments'))
def _(spark, sf):
    return fx.doc_segments(spark, sf).select("media_id", "seg_id", r4("start").alias("start"), r4("end").alias("end"))


@query(
    "wn2_cascade",
    oracle("doc_segments", PLACED_SQL + " SELECT media_id, seg_id, skipped, round(placed_start, 4) AS placed_start, round(placed_end, 4) AS placed_end, round(drift_s, 4) AS drift_s, round(overrun_s, 4) AS overrun_s FROM cascaded"),
)
def _(spark, sf):
    return placed(spark, sf).select(
        "media_id", "seg_id", "skipped", r4("placed_start").alias("placed_start"), r4("placed_end").alias("placed_end"), r4("drift_s").alias("drift_s"), r4("overrun_s").alias("overrun_s")
    )


@query(
    "ag8_drift_summary",
    oracle("doc_segments", PLACED_SQL + """ SELECT media_id, count(*) AS segments, count(*) FILTER (drift_s > 0) AS drifted_segments,
  round(greatest(coalesce(max(drift_s), 0.0::DOUBLE), 0.0::DOUBLE), 4) AS max_drift_s,
  round(round_even(coalesce(max(e_s) FILTER (NOT skipped), 0) / 22050.0::DOUBLE, 2), 4) AS audio_duration_s FROM cascaded GROUP BY media_id"""),
)
def _(spark, sf):
    out = sg.drift_summary(placed(spark, sf), 22050)
    return out.select("media_id", "segments", "drifted_segments", r4("max_drift_s").alias("max_drift_s"), r4("audio_duration_s").alias("audio_duration_s"))


@query(
    "wn3_stretch_plan",
    oracle("doc_segments", """SELECT media_id, seg_id, round(ratio, 4) AS stretch_ratio, round(dur / ratio, 4) AS fitted_dur FROM (
  SELECT *, CASE WHEN slot > 0.05 AND raw / slot > 1.1 THEN least(raw / slot, 1.4::DOUBLE) ELSE 1.0::DOUBLE END AS ratio FROM (
    SELECT *, length(text) / 11.0::DOUBLE AS dur, round_even(length(text) / 11.0::DOUBLE, 2) AS raw, round_even("end" - start, 2) AS slot FROM doc_segments))"""),
)
def _(spark, sf):
    return sg.stretch_plan(spoken(spark, sf)).select("media_id", "seg_id", r4("stretch_ratio").alias("stretch_ratio"), r4("fitted_dur").alias("fitted_dur"))


@query(
    "wn4_flag_implausible",
    oracle("doc_segments", "SELECT media_id, seg_id, d > greatest(6.0::DOUBLE, length(text) / 5.0::DOUBLE) AS implausible FROM (SELECT *, 5.5::DOUBLE + (length(text) % 7) AS d FROM doc_segments)"),
)
def _(spark, sf):
    df = fx.doc_segments(spark, sf).withColumn("dur", F.lit(5.5) + F.length("text") % 7)
    return sg.flag_implausible(df).select("media_id", "seg_id", "implausible")


SENT_SQL = f""",
marked AS (SELECT media_id, seg_id, start, "end", text, list_filter(list_transform(string_split(
    regexp_replace({sql_strip('text')}, '([.!?…]){fx.WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS s FROM doc_segments),
flat AS (SELECT media_id, seg_id, start, "end", len(s) AS n, list_sum(list_transform(s, lambda x: length(x))) AS total,
    unnest(s) AS sent, unnest(range(1, len(s) + 1)) AS i, unnest(list_transform(range(1, len(s) + 1), lambda k: coalesce(list_sum(list_transform(s[1:k-1], lambda x: length(x))), 0))) AS before FROM marked),
split AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_id, i) AS seg_id,
    CASE WHEN i = 1 THEN start ELSE least("end", start + ("end" - start) * before / total) END AS start,
    CASE WHEN i = n THEN "end" ELSE least("end", start + ("end" - start) * (before + length(sent)) / total) END AS "end", sent AS text FROM flat)"""


@query("wn6_split_sentences", oracle("doc_segments", SENT_SQL + ' SELECT media_id, seg_id, round(start, 4) AS start, round("end", 4) AS "end", text FROM split'))
def _(spark, sf):
    out = sg.split_sentences(fx.doc_segments(spark, sf), bounded=True)
    return out.select("media_id", "seg_id", r4("start").alias("start"), r4("end").alias("end"), "text")


@query(
    "wn7_concat_documents",
    oracle("doc_segments", """,
docs AS (SELECT language, media_id, max("end") AS last, count(*) AS n FROM doc_segments GROUP BY ALL),
shifts AS (SELECT language, media_id, coalesce(sum(last::DECIMAL(28,2)) OVER w, 0)::DOUBLE AS shift, coalesce(sum(n) OVER w, 0) AS before FROM docs
  WINDOW w AS (PARTITION BY language ORDER BY media_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT language, media_id, (before + row_number() OVER (PARTITION BY media_id ORDER BY seg_id))::BIGINT AS seg_id,
  round(start + shift, 2) AS start, round("end" + shift, 2) AS "end" FROM doc_segments JOIN shifts USING (language, media_id)"""),
)
def _(spark, sf):
    out = sg.concat_documents(fx.doc_segments(spark, sf), "language", "media_id", small_docs=True)
    return out.select("language", "media_id", "seg_id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


@query(
    "wn8_split_ranges",
    oracle("ev_intervals", """SELECT media_id, event_id, part, round(start_time + part * step, 4) AS start_time,
  round(CASE WHEN n = 1 THEN end_time ELSE start_time + (part + 1) * step END, 4) AS end_time FROM (
  SELECT *, (end_time - start_time) / n AS step, unnest(range(0, n)) AS part FROM (SELECT *, greatest(1, ceil((end_time - start_time) / 15.0::DOUBLE)::INT) AS n FROM ev_intervals))"""),
)
def _(spark, sf):
    out = sg.split_ranges(fx.ev_intervals(spark, sf), 15.0, "start_time", "end_time")
    return out.select("media_id", "event_id", "part", r4("start_time").alias("start_time"), r4("end_time").alias("end_time"))


@query("wn9_batch", oracle("conv_segments", "SELECT media_id, seg_id, ((row_number() OVER (PARTITION BY media_id ORDER BY seg_id) - 1) // 3)::BIGINT AS batch FROM conv_segments"))
def _(spark, sf):
    return sg.batch(fx.conv_segments(spark, sf), 3).select("media_id", "seg_id", "batch")


@query(
    "wn10_chunk_with_context",
    oracle("conv_segments", """, r AS (SELECT media_id, seg_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_id) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM conv_segments)
SELECT media_id, seg_id, (i // 3)::BIGINT AS chunk, false AS is_context FROM r
UNION ALL SELECT media_id, seg_id, (i // 3 + 1)::BIGINT, true FROM r WHERE i % 3 >= 1 AND (i // 3 + 1) * 3 < n"""),
)
def _(spark, sf):
    return sg.chunk_with_context(fx.conv_segments(spark, sf), 3, 2).select("media_id", "seg_id", "chunk", "is_context")


@query("wn5_merge_dangling")
def _(spark, sf):
    out = sg.merge_dangling(fx.conv_segments(spark, sf))
    return out.select("media_id", "seg_id", r4("start").alias("start"), r4("end").alias("end"), "text")


def wrapped(spark, sf):
    return sg.cue_lines(fx.doc_segments(spark, sf))


@query("wn11_cue_lines")
def _(spark, sf):
    # Not an inner one: Spark would wrap twice, once to drop segments without a line.
    out = wrapped(spark, sf).select("media_id", "seg_id", F.posexplode_outer("lines").alias("line_idx", "line"))
    return out.filter(F.col("line_idx").isNotNull())


HALVES_SQL = """,
halves AS (SELECT media_id, seg_id, start, "end", [substr(text, 1, length(text) // 2 + 1), substr(text, length(text) // 2 + 2)] AS lines FROM doc_segments)"""


@query(
    "wn12_cue_times",
    oracle("doc_segments", HALVES_SQL + """ SELECT media_id, seg_id, i AS cue, round(CASE WHEN i = 1 THEN start ELSE cut END, 4) AS start, round(CASE WHEN i = 2 THEN "end" ELSE cut END, 4) AS "end", line FROM (
 SELECT media_id, seg_id, start, "end", unnest([1, 2]) AS i, unnest(lines) AS line,
   least("end", start + ("end" - start) * length(lines[1]) / greatest(length(lines[1]) + length(lines[2]), 1)) AS cut FROM halves)"""),
)
def _(spark, sf):
    half = F.floor(F.length("text") / 2).cast("int")
    lines = F.array(F.substring(F.col("text"), F.lit(1), half + 1), F.substring(F.col("text"), half + 2, F.length("text")))
    out = sg.cue_times(fx.doc_segments(spark, sf).withColumn("lines", lines))
    return out.select("media_id", "seg_id", "cue", r4("start").alias("start"), r4("end").alias("end"), "line")


@query(
    "ag9_cue_summary",
    oracle("doc_segments", HALVES_SQL + """ SELECT media_id, count(*) AS segments, 2 * count(*) AS cues,
  count(*) FILTER (length(text) > 400 OR "end" - start > 25.0) AS oversized_segments FROM doc_segments GROUP BY media_id"""),
)
def _(spark, sf):
    seg = fx.doc_segments(spark, sf)
    half = F.floor(F.length("text") / 2).cast("int")
    lines = F.array(F.substring(F.col("text"), F.lit(1), half + 1), F.substring(F.col("text"), half + 2, F.length("text")))
    return sg.cue_summary(seg, sg.cue_times(seg.withColumn("lines", lines)))


LAUGH_RE2 = r"(?i)^(?:[\s.,!?~…]*(?:ha|he|hi|ho))+[\s.,!?~…]*$"


def gate_sql(t):
    return f"""(CASE WHEN coalesce(length({t}), 0) = 0 THEN true
  WHEN (length({t}) - length(regexp_replace({t}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]', '', 'g'))) / length({t}) > 0.3 THEN true
  WHEN regexp_matches({t}, '{LAUGH_RE2}') THEN false
  WHEN length({t}) >= 12 AND NOT regexp_matches({t}, '[{sg.VIETNAMESE_LETTERS}]') THEN true ELSE false END)"""


@query("fl10_flag_untranslated", oracle("doc_lines", f"SELECT media_id, seg_id, {gate_sql('text')} AS untranslated FROM doc_lines"))
def _(spark, sf):
    return sg.flag_untranslated(fx.doc_lines(spark, sf)).select("media_id", "seg_id", "untranslated")


@query("fl17_route_pages", oracle("doc_lines", "SELECT media_id, seg_id, CASE WHEN length(text) < 20 THEN 'ocr' ELSE 'text_layer' END AS route FROM doc_lines"))
def _(spark, sf):
    return sg.route_pages(fx.doc_lines(spark, sf)).select("media_id", "seg_id", "route")


@query("fl18_route_engine", "SELECT doc_id, CASE WHEN lang = 'zh' THEN 'paraformer' ELSE 'whisper' END AS engine FROM documents")
def _(spark, sf):
    return sg.route_engine(fx.table(spark, sf, "documents"), "lang").select("doc_id", "engine")


@query(
    "ag13_media_text",
    oracle("conv_segments", "SELECT media_id, substr(string_agg(text, ' ' ORDER BY seg_id), 1, 6000) AS text FROM conv_segments GROUP BY media_id"),
)
def _(spark, sf):
    return sg.media_text(fx.conv_segments(spark, sf))


@query(
    "ag14_book_text",
    oracle("conv_segments", """, l AS (SELECT media_id, string_agg(CASE WHEN speaker = 'narrator' THEN text ELSE '[' || speaker || '] ' || text END, chr(10) ORDER BY seg_id) AS t FROM conv_segments GROUP BY media_id)
SELECT media_id, length(t)::BIGINT AS n_chars, CASE WHEN length(t) <= 6000 THEN t END AS preview FROM l"""),
)
def _(spark, sf):
    return sg.book_text(fx.conv_segments(spark, sf))


def page_boxes(spark, sf):
    """Boxes derived from document words: word i of a line stands at x = 40 i, with a jitter in y."""
    return (
        fx.doc_lines(spark, sf)
        .select(F.col("media_id").alias("page_id"), "seg_id", F.posexplode(F.split("text", " ")).alias("w", "text"))
        .select(
            "page_id",
            (F.col("seg_id") * 100000 + F.col("w")).alias("line_idx"),
            (F.pmod(F.col("w"), F.lit(12)) * 40).alias("x"),
            (F.col("seg_id") * 400 + F.floor(F.col("w") / 12) * 30 + F.pmod(F.length("text"), F.lit(7))).alias("y"),
            "text",
        )
    )


@query("wn27_reading_order")
def _(spark, sf):
    out = sg.reading_order(page_boxes(spark, sf))
    return out.select("page_id", "line_idx", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "reading_pos")


@query(
    "wn28_page_text",
    oracle("doc_lines", "SELECT media_id AS page_id, string_agg(text, ' ' ORDER BY seg_id) AS text FROM doc_lines GROUP BY media_id"),
)
def _(spark, sf):
    lines = fx.doc_lines(spark, sf).select(F.col("media_id").alias("page_id"), F.col("seg_id").alias("line_idx"), "text")
    return sg.page_text(lines)


@query(
    "sc34_filter_words",
    oracle("doc_segments", """SELECT media_id, seg_id, w AS word, round(round_even(ws, 2), 4) AS start, round(round_even(coalesce(we, start), 2), 4) AS "end" FROM (
  SELECT media_id, seg_id, start, w, CASE WHEN i % 5 <> 4 THEN start + i * 0.3371339 END AS ws, CASE WHEN i % 3 <> 2 THEN start + i * 0.3371339 + 0.25 END AS we FROM (
    SELECT *, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM doc_segments)) WHERE ws IS NOT NULL"""),
)
def _(spark, sf):
    words = F.transform(
        F.split("text", " "),
        lambda w, i: F.struct(
            w.alias("word"),
            F.when(i % 5 != 4, F.col("start") + i * F.lit(0.3371339)).alias("start"),
            F.when(i % 3 != 2, F.col("start") + i * F.lit(0.3371339) + 0.25).alias("end"),
        ),
    )
    df = fx.doc_segments(spark, sf).select("media_id", "seg_id", F.explode(sg.filter_words(words, F.col("start"))).alias("w"))
    return df.select("media_id", "seg_id", "w.word", r4("w.start").alias("start"), r4("w.end").alias("end"))
