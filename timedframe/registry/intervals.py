"""Checked queries over interval algebra."""

from pyspark.sql import functions as F

from timedframe import fixtures as fx
from timedframe.fixtures import oracle
from timedframe.operators import intervals as iv
from timedframe.registry.core import query
from timedframe.semantics import r4

STRETCH = 600


def spans(spark, sf):
    """User intervals stretched so that neighbours overlap; ends are exact to the microsecond."""
    e = fx.ev_intervals(spark, sf)
    end = (F.col("start_us") + (F.col("end_us") - F.col("start_us")) * STRETCH) / F.lit(1000000.0)
    return e.select("media_id", "event_id", "category", "title", "start_time", end.alias("end_time"))


SPANS = f""", spans AS (SELECT media_id, event_id, category, title, start_us, start_us + (end_us - start_us) * {STRETCH} AS end_us,
  start_time, (start_us + (end_us - start_us) * {STRETCH}) / 1000000.0::DOUBLE AS end_time FROM ev_intervals),
media AS (SELECT media_id, max(end_us) AS dur_us, max(end_time) AS duration FROM spans GROUP BY media_id),
cuts AS (SELECT * FROM spans WHERE category = 'error'),
reach AS (SELECT *, max(end_us) OVER (PARTITION BY media_id ORDER BY start_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM cuts),
isl AS (SELECT *, sum(CASE WHEN r >= start_us THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_us, event_id) AS cut_no FROM reach),
merged AS (SELECT media_id, cut_no, min(start_us) AS s, max(end_us) AS e FROM isl GROUP BY ALL)"""


def cents(c):
    """Two decimals by a scaled double, as the oracle rounds; Spark's own ``round`` goes by the printed digits."""
    return F.round(F.col(c) * F.lit(100.0)) / F.lit(100.0)


def media(spark, sf):
    return spans(spark, sf).groupBy("media_id").agg(F.max("end_time").alias("duration"))


def cuts(spark, sf):
    return spans(spark, sf).filter(F.col("category") == "error")


def raw_chapters(spark, sf):
    """Chapters from view and signup events, with holes in their fields."""
    k = F.col("event_id")
    e = fx.ev_intervals(spark, sf).filter(F.col("category").isin("view", "signup"))
    return e.select("media_id", k.alias("idx"), "start_time", F.lit(None).cast("double").alias("end_time"), F.when(k % 3 != 0, F.concat(F.col("title"), F.lit(" "), k.cast("string"))).alias("title"))


CHAPTERS = """, heads AS (SELECT media_id, idx, start_time, title FROM (SELECT media_id, event_id AS idx, start_time, CASE WHEN event_id % 3 <> 0 THEN title || ' ' || event_id END AS title FROM ev_intervals WHERE category IN ('view', 'signup'))),
led AS (SELECT media_id, min(idx) - 1 AS idx, 0.0::DOUBLE AS start_time, NULL AS title FROM heads GROUP BY media_id HAVING arg_min(start_time, idx) > 0),
allc AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY idx) AS no, lead(start_time) OVER (PARTITION BY media_id ORDER BY idx) AS ns FROM (SELECT * FROM heads UNION ALL SELECT * FROM led)),
chapters AS (SELECT c.media_id, no AS idx, start_time, coalesce(ns, duration) AS end_time, coalesce(title, '<Untitled Chapter ' || no || '>') AS title FROM allc c LEFT JOIN media USING (media_id))"""


def chapters(spark, sf):
    return iv.fill_chapters(raw_chapters(spark, sf), media(spark, sf))


@query("wn14_fill_chapters", oracle("ev_intervals", SPANS + CHAPTERS + " SELECT media_id, idx, round(start_time, 4) AS start_time, round(end_time, 4) AS end_time, title FROM chapters"))
def _(spark, sf):
    return chapters(spark, sf).select("media_id", "idx", r4("start_time").alias("start_time"), r4("end_time").alias("end_time"), "title")


@query(
    "wn15_valid_chapters",
    oracle("ev_intervals", SPANS + """, c AS (SELECT media_id, event_id AS idx, CASE WHEN event_id % 5 = 0 THEN start_time * 1.7 ELSE start_time END AS st FROM ev_intervals),
j AS (SELECT c.media_id, idx, st, duration, max(CASE WHEN st <= duration THEN st END) OVER (PARTITION BY c.media_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM c JOIN media ON c.media_id = media.media_id)
SELECT media_id, idx FROM j WHERE st <= duration AND st >= coalesce(top, 0)"""),
)
def _(spark, sf):
    c = fx.ev_intervals(spark, sf).select("media_id", F.col("event_id").alias("idx"), F.when(F.col("event_id") % 5 == 0, F.col("start_time") * F.lit(1.7)).otherwise(F.col("start_time")).alias("start_time"))
    return iv.valid_chapters(c, media(spark, sf)).select("media_id", "idx")


@query("wn16_chapters_from_text")
def _(spark, sf):
    at = F.floor(F.col("start")).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", F.floor(at / 3600).cast("string"), two(F.floor(at / 60) % 60), two(at % 60))
    line = F.when(F.col("media_id") % 2 == 0, F.concat(clock, F.lit(" - "), "text")).otherwise(F.concat("text", F.lit(" - "), clock))
    seg = fx.doc_segments(spark, sf).withColumn("line", line)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "line"))), lambda s: s["line"]), "\n")
    d = seg.groupBy("media_id").agg(joined.alias("description"), (F.max("end") + 60).alias("duration"))
    return iv.chapters_from_text(d)


@query(
    "wn17_clean_sponsor_segments",
    oracle("ev_intervals", SPANS + """, x AS (SELECT s.*, duration, CASE WHEN event_id % 4 = 0 THEN duration + 3 WHEN event_id % 4 = 1 THEN 0 WHEN event_id % 4 = 2 THEN duration + 0.5 ELSE duration + 9 END AS vd,
  CASE WHEN event_id % 6 = 0 THEN 'poi_highlight' ELSE category END AS cat FROM spans s JOIN media USING (media_id)),
y AS (SELECT *, CASE WHEN start_time <= 1 THEN 0 ELSE start_time END AS st, end_time + CASE WHEN cat = 'poi_highlight' THEN 1 ELSE 0 END AS e1 FROM x),
z AS (SELECT *, CASE WHEN duration - e1 <= 1 THEN duration ELSE e1 END AS en, CASE WHEN vd <> 0 THEN abs(duration - vd) ELSE 0 END AS diff FROM y)
SELECT media_id, event_id, round(st, 2) AS start_time, round(en, 2) AS end_time FROM z WHERE diff < 1 OR (diff < 5 AND en - st <> 0 AND diff / (en - st) < 0.05)"""),
)
def _(spark, sf):
    k = F.col("event_id")
    d = F.col("duration")
    vd = F.when(k % 4 == 0, d + 3).when(k % 4 == 1, 0.0).when(k % 4 == 2, d + 0.5).otherwise(d + 9)
    s = spans(spark, sf).join(media(spark, sf), "media_id").withColumn("video_duration", vd)
    s = s.withColumn("category", F.when(k % 6 == 0, "poi_highlight").otherwise(F.col("category")))
    return iv.clean_sponsor_segments(s).select("media_id", "event_id", cents("start_time").alias("start_time"), cents("end_time").alias("end_time"))


@query("wn18_merge_cuts", oracle("ev_intervals", SPANS + " SELECT media_id, cut_no::BIGINT AS cut_no, round(s / 1000000.0::DOUBLE, 4) AS start_time, round(e / 1000000.0::DOUBLE, 4) AS end_time FROM merged"))
def _(spark, sf):
    return iv.merge_cuts(cuts(spark, sf)).select("media_id", "cut_no", r4("start_time").alias("start_time"), r4("end_time").alias("end_time"))


@query(
    "wn19_remap_chapters",
    oracle("ev_intervals", SPANS + CHAPTERS + """, cu AS (SELECT *, round(start_time * 1000000)::BIGINT AS cs, round(end_time * 1000000)::BIGINT AS ce FROM chapters),
lost AS (SELECT cu.media_id, cu.idx, sum(least(ce, e) - greatest(cs, s)) AS lost FROM cu JOIN merged m ON cu.media_id = m.media_id AND s < ce AND e > cs GROUP BY ALL),
lens AS (SELECT cu.*, ce - cs - coalesce(lost, 0) AS len FROM cu LEFT JOIN lost ON cu.media_id = lost.media_id AND cu.idx = lost.idx)
SELECT media_id, idx, round((u - len) / 1000000.0::DOUBLE, 4) AS start_time, round(u / 1000000.0::DOUBLE, 4) AS end_time FROM (SELECT *, sum(len) OVER (PARTITION BY media_id ORDER BY cs, idx) AS u FROM lens WHERE len > 0)"""),
)
def _(spark, sf):
    return iv.remap_chapters(chapters(spark, sf), cuts(spark, sf)).select("media_id", "idx", r4("start_time").alias("start_time"), r4("end_time").alias("end_time"))


@query(
    "wn22_keep_ranges",
    oracle("ev_intervals", SPANS + """, b AS (SELECT media_id, s, e FROM merged UNION ALL SELECT media_id, dur_us, NULL FROM media),
l AS (SELECT media_id, coalesce(lag(e) OVER (PARTITION BY media_id ORDER BY e IS NULL, s), 0) AS s, s AS e FROM b)
SELECT media_id, round(s / 1000000.0::DOUBLE, 4) AS start_time, round(e / 1000000.0::DOUBLE, 4) AS end_time FROM l WHERE s < e"""),
)
def _(spark, sf):
    return iv.keep_ranges(cuts(spark, sf), media(spark, sf)).select("media_id", r4("start_time").alias("start_time"), r4("end_time").alias("end_time"))


def kinds(spark, sf):
    ch = chapters(spark, sf).select("media_id", F.lit("chapter").alias("kind"), "start_time", "end_time", "title", F.lit(None).cast("string").alias("category"))
    sp = spans(spark, sf).filter(F.col("category").isin("click", "purchase", "error"))
    return ch.unionByName(sp.select("media_id", F.lit("sponsor").alias("kind"), "start_time", "end_time", F.initcap("category").alias("title"), "category"))


@query(
    "fl16_mark_cuts",
    oracle("ev_intervals", SPANS + CHAPTERS + """ SELECT media_id, 'chapter' AS kind, round(start_time, 4) AS start_time, regexp_matches(title, 'signup|7>') AS remove FROM chapters
UNION ALL SELECT media_id, 'sponsor', round(start_time, 4), category IN ('error') FROM spans WHERE category IN ('click', 'purchase', 'error')
UNION ALL SELECT DISTINCT media_id, 'cut', 100.5, true FROM spans"""),
)
def _(spark, sf):
    out = iv.mark_cuts(kinds(spark, sf), ["signup", "7>"], ["error"], [(100.5, 130.0)])
    return out.select("media_id", "kind", r4("start_time").alias("start_time"), "remove")


@query(
    "fl19_select_ranges",
    oracle("ev_intervals", SPANS + CHAPTERS + """ SELECT media_id, round(start_time, 4) AS start_time, round(end_time, 4) AS end_time, title FROM chapters WHERE regexp_matches(title, 'view 1')
UNION ALL SELECT media_id, 10.0, 20.0, NULL FROM media UNION ALL SELECT media_id, round(greatest(duration - 30, 0), 4), round(greatest(duration - 5, 0), 4), NULL FROM media"""),
)
def _(spark, sf):
    out = iv.select_ranges(media(spark, sf), chapters(spark, sf), ["view 1"], [(10, 20), (-30, -5)])
    return out.select("media_id", r4("start_time").alias("start_time"), r4("end_time").alias("end_time"), "title")


@query(
    "wn30_expand_sections",
    oracle("ev_intervals", SPANS + """, f AS (SELECT media_id, 'f' || (event_id % 7) AS format_id, event_id FROM ev_intervals),
r AS (SELECT media_id, event_id % 3 AS range_no, min(start_time) AS start_time, CASE WHEN event_id % 3 > 0 THEN max(end_time) * 3 END AS end_time, min(title) AS title FROM spans GROUP BY media_id, event_id % 3)
SELECT f.media_id, f.event_id, format_id, range_no AS section_number, round(4 + start_time, 2) AS section_start, round(4 + least(coalesce(end_time, duration), duration), 2) AS section_end, title AS section_title
FROM f JOIN r USING (media_id) JOIN media USING (media_id)"""),
)
def _(spark, sf):
    f = fx.ev_intervals(spark, sf).select("media_id", F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("format_id"), "event_id")
    # Three ranges for each medium from all its spans, so that sections grow with the formats.
    r = spans(spark, sf).groupBy("media_id", (F.col("event_id") % 3).alias("range_no")).agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("last"), F.min("title").alias("title"))
    r = r.select("media_id", "range_no", "start_time", F.when(F.col("range_no") > 0, F.col("last") * 3).alias("end_time"), "title")
    out = iv.expand_sections(f, r, media(spark, sf).withColumn("section_start", F.lit(4.0)))
    return out.select("media_id", "event_id", "format_id", "section_number", F.round("section_start", 2).alias("section_start"), F.round("section_end", 2).alias("section_end"), "section_title")


def overlaid(spark, sf):
    return iv.overlay_intervals(iv.mark_cuts(kinds(spark, sf), ["signup"], ["error"]))


@query("wn20_overlay_intervals")
def _(spark, sf):
    out = overlaid(spark, sf)
    return out.select("media_id", "piece", r4("start_time").alias("start_time"), r4("end_time").alias("end_time"), "title", F.to_json("cats").alias("cats"), "was_cut")


@query("wn21_fold_tiny")
def _(spark, sf):
    out = iv.fold_tiny(overlaid(spark, sf))
    return out.select("media_id", "chapter", r4("start_time").alias("start_time"), r4("end_time").alias("end_time"), "title", "category", F.array_join("categories", ",").alias("categories"))


@query(
    "jn11_overlap_ratio",
    oracle("ev_intervals", SPANS + """, w AS (SELECT media_id, event_id AS seg_id, start_time, start_time + CASE WHEN event_id % 8 = 0 THEN 0 ELSE 20000 END AS e, start_us AS s_us, start_us + CASE WHEN event_id % 8 = 0 THEN 0 ELSE 20000000000 END AS e_us FROM ev_intervals WHERE category = 'view'),
o AS (SELECT w.media_id, seg_id, sum(least(e_us, end_us) - greatest(s_us, start_us)) AS v FROM w JOIN spans s ON w.media_id = s.media_id AND start_us < e_us AND end_us > s_us WHERE s.category IN ('click', 'purchase') GROUP BY ALL)
SELECT w.media_id, w.seg_id, round(CASE WHEN e_us > s_us THEN least(1.0, coalesce(v, 0) / 1000000.0::DOUBLE / (e - start_time)) ELSE 0 END, 4) AS score FROM w LEFT JOIN o ON w.media_id = o.media_id AND w.seg_id = o.seg_id"""),
)
def _(spark, sf):
    w = fx.ev_intervals(spark, sf).filter(F.col("category") == "view").select("media_id", F.col("event_id").alias("seg_id"), F.col("start_time").alias("start"), (F.col("start_time") + F.when(F.col("event_id") % 8 == 0, 0).otherwise(20000)).alias("end"))
    i = spans(spark, sf).filter(F.col("category").isin("click", "purchase"))
    return iv.overlap_ratio(w, i).select("media_id", "seg_id", r4("score").alias("score"))


@query(
    "jn12_best_candidate",
    "SELECT user_id AS media_id, k AS seg_id, arg_min(event_type, (score, pr)) AS candidate, min(score) AS score FROM (SELECT *, event_id % 9 AS k, floor(value / 20)::BIGINT AS score, event_id AS pr FROM events) GROUP BY ALL",
)
def _(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("media_id"), (F.col("event_id") % 9).alias("seg_id"), F.col("event_type").alias("candidate"), F.floor(F.col("value") / 20).alias("score"), F.col("event_id").alias("priority"))
    return iv.best_candidate(e)


@query(
    "wn26_unwrap_clock",
    oracle("ev_signal", """, c AS (SELECT series_id, t_idx, (t_idx * 3000000000 + value::BIGINT) % 8589934592 AS clock FROM ev_signal), d AS (SELECT *, (clock < lag(clock) OVER (PARTITION BY series_id ORDER BY t_idx))::INT AS w FROM c)
SELECT series_id, t_idx, (clock + coalesce(sum(w) OVER (PARTITION BY series_id ORDER BY t_idx), 0) * 8589934592)::BIGINT AS unwrapped FROM d"""),
)
def _(spark, sf):
    c = fx.ev_signal(spark, sf).select("series_id", "t_idx", F.pmod(F.col("t_idx") * 3000000000 + F.rint("value").cast("bigint"), F.lit(2**33)).alias("clock"))
    return iv.unwrap_clock(c, "series_id", "t_idx").select("series_id", "t_idx", "unwrapped")


@query(
    "ag15_window_gain",
    oracle("ev_signal", """, s AS (SELECT series_id, t_idx - 1 AS t, value / 100 AS bg, CASE WHEN t_idx % 3 = 0 THEN 0 ELSE value / 300 END AS vo FROM ev_signal),
w AS (SELECT series_id, t_idx AS seg_id, t_idx - 1 AS a, t_idx + 4 AS b FROM ev_signal WHERE t_idx % 6 = 1),
r AS (SELECT w.series_id, seg_id, sqrt(avg(bg * bg)) AS bg_rms, coalesce(sqrt(avg(vo * vo) FILTER (abs(vo) > 1e-4)), 0) AS voice_rms FROM w JOIN s ON w.series_id = s.series_id AND t >= a AND t < b GROUP BY ALL)
SELECT series_id, seg_id, round(bg_rms, 4) AS bg_rms, round(voice_rms, 4) AS voice_rms, round(CASE WHEN bg_rms > 1e-6 AND voice_rms > 1e-6 THEN least(greatest(bg_rms / voice_rms, 1), 4) ELSE 1 END, 4) AS gain FROM r"""),
)
def _(spark, sf):
    t = F.col("t_idx")
    g = fx.ev_signal(spark, sf)
    s = g.select("series_id", (t - 1).alias("t_idx"), (F.col("value") / 100).alias("background"), F.when(t % 3 == 0, 0.0).otherwise(F.col("value") / 300).alias("voice"))
    w = g.filter(t % 6 == 1).select("series_id", t.alias("seg_id"), (t - 1).alias("start_i"), (t + 4).alias("end_i"))
    return iv.window_gain(s, w).select("series_id", "seg_id", r4("bg_rms").alias("bg_rms"), r4("voice_rms").alias("voice_rms"), r4("gain").alias("gain"))


@query(
    "ag15_quiet_after_loud",
    oracle("ev_signal", """, s AS (SELECT series_id, t_idx - 1 AS t, CASE WHEN t_idx <= 20 THEN 1000 ELSE 1e-4 END * value / 100 AS bg, CASE WHEN t_idx <= 20 THEN 900 ELSE 3e-3 END * value / 300 AS vo FROM ev_signal),
w AS (SELECT series_id, t_idx AS seg_id, t_idx - 1 AS a, t_idx + 4 AS b FROM ev_signal WHERE t_idx % 6 = 1),
r AS (SELECT w.series_id, seg_id, sqrt(avg(bg * bg)) AS bg_rms, coalesce(sqrt(avg(vo * vo) FILTER (abs(vo) > 1e-4)), 0) AS voice_rms FROM w JOIN s ON w.series_id = s.series_id AND t >= a AND t < b GROUP BY ALL)
SELECT series_id, seg_id, round(bg_rms, 7) AS bg_rms, round(voice_rms, 7) AS voice_rms FROM r"""),
)
def _(spark, sf):
    g, t = fx.ev_signal(spark, sf), F.col("t_idx")
    loud = lambda a, b: F.when(t <= 20, F.lit(float(a))).otherwise(F.lit(b)) * F.col("value")
    s = g.select("series_id", (t - 1).alias("t_idx"), (loud(1000, 1e-4) / 100).alias("background"), (loud(900, 3e-3) / 300).alias("voice"))
    w = g.filter(t % 6 == 1).select("series_id", t.alias("seg_id"), (t - 1).alias("start_i"), (t + 4).alias("end_i"))
    out = iv.window_gain(s, w)
    return out.select("series_id", "seg_id", F.round("bg_rms", 7).alias("bg_rms"), F.round("voice_rms", 7).alias("voice_rms"))


@query("ag16_peak_normalize", oracle("ev_signal", ", p AS (SELECT *, max(abs(value)) OVER (PARTITION BY series_id) AS pk FROM ev_signal) SELECT series_id, t_idx, round(CASE WHEN pk > 0.99 THEN value * (0.99::DOUBLE / pk) ELSE value END, 4) + 0.0 AS value FROM p"))
def _(spark, sf):
    return iv.peak_normalize(fx.ev_signal(spark, sf)).select("series_id", "t_idx", r4("value").alias("value"))
