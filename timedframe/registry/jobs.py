"""Checked queries over job events."""

from pyspark.sql import functions as F

from timedframe import fixtures as fx
from timedframe.fixtures import oracle
from timedframe.operators import jobs as jb
from timedframe.registry.core import query
from timedframe.semantics import r4, secs

TODAY = "2024-01-30"
NOW = "2024-01-30 23:50:00"

STATE_SQL = """, state AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, min(ts) AS created_at, max(ts) AS updated_at,
  count(*) FILTER (status = 'pending') AS submissions FROM job_events GROUP BY job_id)"""


def state(spark, sf):
    return jb.job_state(fx.job_events(spark, sf))


def service(job="job_id"):
    return F.concat(F.lit("s"), (F.col(job) % 4).cast("string"))


@query("st1_job_state", oracle("job_events", STATE_SQL + " SELECT job_id, status, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us, submissions FROM state"))
def _(spark, sf):
    return state(spark, sf).select("job_id", "status", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"), "submissions")


@query(
    "st1_transition_audit",
    oracle("job_events", """, l AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS from_status FROM job_events)
SELECT event_id, from_status, coalesce((from_status IS NULL AND status = 'pending') OR (from_status = 'pending' AND status IN ('started', 'cancelled'))
  OR (from_status = 'started' AND status IN ('finished', 'failed', 'cancelled')) OR (from_status IN ('failed', 'cancelled') AND status = 'pending'), false) AS allowed FROM l"""),
)
def _(spark, sf):
    return jb.transition_audit(fx.job_events(spark, sf)).select("event_id", "from_status", "allowed")


@query("ag1_queue_depth", oracle("job_events", STATE_SQL + " SELECT 's' || (job_id % 4) AS service, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'started') AS processing FROM state GROUP BY 1"))
def _(spark, sf):
    return jb.queue_depth(state(spark, sf).withColumn("service", service()))


@query("ag2_total_jobs", "SELECT count(DISTINCT user_id) AS total_jobs FROM events")
def _(spark, sf):
    return jb.total_jobs(fx.job_events(spark, sf))


@query(
    "ag3_finished_since",
    oracle("job_events", STATE_SQL + """ SELECT count(*) FILTER (updated_at >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (updated_at >= TIMESTAMP '2024-01-29') AS this_week,
  count(*) FILTER (updated_at >= TIMESTAMP '2024-01-01') AS this_month FROM state WHERE status = 'finished'"""),
)
def _(spark, sf):
    return jb.finished_since(state(spark, sf), TODAY)


def usage(spark, sf):
    return fx.job_events(spark, sf).select("ts", "job_id", F.col("k").alias("tokens"))


@query(
    "ag4_token_stats",
    oracle("job_events", """SELECT sum(k) FILTER (ts::DATE = DATE '2024-01-30')::BIGINT AS today, sum(k) FILTER (ts::DATE BETWEEN '2024-01-29' AND '2024-01-30')::BIGINT AS this_week,
  sum(k) FILTER (ts::DATE BETWEEN '2024-01-01' AND '2024-01-30')::BIGINT AS this_month FROM job_events"""),
)
def _(spark, sf):
    return jb.token_stats(usage(spark, sf), TODAY)


@query(
    "ag5_usage_summary",
    oracle("job_events", """, m AS (SELECT job_id, stage, sum(k) AS p, sum(length(stage)) AS c, count(*) AS n FROM job_events GROUP BY ALL)
SELECT job_id, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens, string_agg(stage || '=' || n, ';' ORDER BY stage) AS calls FROM m GROUP BY job_id"""),
)
def _(spark, sf):
    calls = fx.job_events(spark, sf).select("job_id", F.col("stage").alias("model"), F.col("k").alias("prompt_tokens"), F.length("stage").cast("bigint").alias("completion_tokens"))
    entries = F.transform(F.map_entries("calls_by_model"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    out = jb.usage_summary(calls)
    return out.select("job_id", "prompt_tokens", "completion_tokens", "total_tokens", F.array_join(entries, ";").alias("calls"))


STAGES_SQL = """, latest AS (SELECT job_id, stage, arg_max(elapsed_s, (ts, event_id)) AS elapsed_s, arg_max(status, (ts, event_id)) AS status, max((ts, event_id)) AS seen FROM job_events GROUP BY ALL)"""


@query(
    "st2_stage_progress",
    oracle("job_events", STAGES_SQL + " SELECT job_id, string_agg(stage || ':' || status, ';' ORDER BY stage) AS stages, arg_max(stage, seen) AS current_stage FROM latest GROUP BY job_id"),
)
def _(spark, sf):
    out = jb.stage_progress(fx.job_events(spark, sf))
    text = F.array_join(F.transform(F.map_entries("stages"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["status"])), ";")
    return out.select("job_id", text.alias("stages"), "current_stage")


@query("ag6_stage_elapsed", oracle("job_events", STAGES_SQL + " SELECT job_id, round(nullif(round(sum(elapsed_s + 0.003), 1), 0), 4) AS total_elapsed_s FROM latest GROUP BY job_id"))
def _(spark, sf):
    ev = fx.job_events(spark, sf).withColumn("elapsed_s", F.col("elapsed_s") + 0.003)
    return jb.stage_elapsed(jb.stage_progress(ev)).select("job_id", r4("total_elapsed_s").alias("total_elapsed_s"))


@query("ag7_flag_ratio", "SELECT user_id AS media_id, count(*) FILTER (value / 100 > 0.5) AS flagged, round(count(*) FILTER (value / 100 > 0.5) / count(*), 4) AS ratio FROM events GROUP BY user_id")
def _(spark, sf):
    seg = fx.table(spark, sf, "events").select(F.col("user_id").alias("media_id"), (F.col("value") / 100).alias("residual_risk"))
    return jb.flag_ratio(seg).select("media_id", "flagged", r4("ratio").alias("ratio"))


@query("ag12_dispatch_summary", "SELECT user_id AS job_id, bool_or(event_type <> 'error') AS ok, count(*) FILTER (event_type <> 'error') AS sent, count(*) AS total FROM events GROUP BY user_id")
def _(spark, sf):
    return jb.dispatch_summary(fx.job_events(spark, sf).withColumn("ok", F.col("status") != "failed"))


BEATS_SQL = ", beats AS (SELECT 's' || (job_id % 6) AS service, ts FROM job_events WHERE job_id % 6 <> 1)"


def beats(spark, sf):
    return fx.job_events(spark, sf).filter(F.col("job_id") % 6 != 1).select(F.concat(F.lit("s"), (F.col("job_id") % 6).cast("string")).alias("service"), "ts")


@query(
    "st3_liveness",
    oracle("job_events", " SELECT job_id AS worker, epoch_us(max(ts)) AS last_us, max(ts) >= TIMESTAMP '2024-01-30 23:50:00' - INTERVAL 30 SECOND AS alive FROM job_events GROUP BY job_id"),
)
def _(spark, sf):
    out = jb.liveness(fx.job_events(spark, sf).withColumnRenamed("job_id", "worker"), NOW)
    return out.select("worker", F.unix_micros("last_beat").alias("last_us"), "alive")


@query(
    "ag18_node_status",
    oracle("job_events", STATE_SQL + BEATS_SQL + """, d AS (SELECT 's' || (job_id % 4) AS service, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'started') AS processing FROM state GROUP BY 1),
a AS (SELECT service, max(ts) >= TIMESTAMP '2024-01-30 23:50:00' - INTERVAL 30 SECOND AS alive FROM beats GROUP BY 1)
SELECT coalesce(a.service, d.service) AS service, coalesce(alive, false) AS alive, coalesce(pending, 0) AS pending, coalesce(processing, 0) AS processing FROM a FULL JOIN d ON a.service = d.service"""),
)
def _(spark, sf):
    return jb.node_status(beats(spark, sf), jb.queue_depth(state(spark, sf).withColumn("service", service())), NOW)


@query(
    "st4_stale_jobs",
    oracle("job_events", STATE_SQL + """ SELECT job_id, 'w' || (job_id % 5) AS worker, row_number() OVER (PARTITION BY job_id % 5 ORDER BY updated_at, job_id) AS requeue_position, 'pending' AS status
FROM state WHERE status = 'started' AND job_id % 5 NOT IN (1, 3)"""),
)
def _(spark, sf):
    st = state(spark, sf).withColumn("worker", F.concat(F.lit("w"), (F.col("job_id") % 5).cast("string")))
    alive = st.filter(F.col("job_id") % 5 % 2 == 1).select("worker")
    return jb.stale_jobs(st, alive).select("job_id", "worker", "requeue_position", "status")


def requests(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("event_type").alias("domain"), "event_id", "ts")


@query(
    "st6_rate_violations",
    """SELECT domain, event_id, in_window::BIGINT AS in_window FROM (SELECT event_type AS domain, event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 5""",
)
def _(spark, sf):
    return jb.rate_violations(requests(spark, sf), 5, 3600.0)


@query("st5_rate_limit")
def _(spark, sf):
    out = jb.rate_limit(requests(spark, sf), 5, 600.0)
    return out.select("domain", "event_id", F.round("admitted_at", 3).alias("admitted_at"), F.round("waited_s", 3).alias("waited_s"), "warned")


@query("st7_daily_tokens", oracle("job_events", "SELECT strftime(ts, '%Y-%m-%d') AS day, sum(k)::BIGINT AS tokens FROM job_events GROUP BY 1"))
def _(spark, sf):
    return jb.daily_tokens(usage(spark, sf)).select(F.col("day").cast("string").alias("day"), "tokens")


@query(
    "st13_throughput",
    oracle("job_events", """, d AS (SELECT ts FROM job_events WHERE status = 'finished') SELECT unit, strftime(period, '%Y-%m-%d') AS period, count(*) AS finished FROM (
SELECT 'day' AS unit, date_trunc('day', ts) AS period FROM d UNION ALL SELECT 'week', date_trunc('week', ts) FROM d UNION ALL SELECT 'month', date_trunc('month', ts) FROM d) GROUP BY ALL"""),
)
def _(spark, sf):
    return jb.throughput(fx.job_events(spark, sf)).select("unit", F.col("period").cast("string").alias("period"), "finished")


@query(
    "st11_prune",
    """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'notes' ELSE strftime(ts, '%Y-%m-%d') END AS date FROM events WHERE event_id % 50 = 0 OR ts::DATE >= DATE '2024-01-28'""",
)
def _(spark, sf):
    ev = fx.table(spark, sf, "events")
    name = F.when(F.col("event_id") % 50 == 0, "notes").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return jb.prune(ev.select("event_id", name.alias("date")), TODAY)


@query(
    "st12_apply_cancels",
    oracle("job_events", """, c AS (SELECT user_id AS job_id, event_id AS cancel_id, ts + INTERVAL 1 SECOND AS ts FROM events WHERE event_id % 7 = 0)
SELECT c.job_id, c.cancel_id, e.status AS state_before, CASE e.status WHEN 'pending' THEN 'cancelled' WHEN 'started' THEN 'cancelling' ELSE 'rejected' END AS verdict
FROM c ASOF LEFT JOIN job_events e ON c.job_id = e.job_id AND c.ts >= e.ts"""),
)
def _(spark, sf):
    ev = fx.job_events(spark, sf)
    cancels = ev.filter(F.col("event_id") % 7 == 0).select("job_id", F.col("event_id").alias("cancel_id"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"))
    return jb.apply_cancels(ev, cancels).select("job_id", "cancel_id", "state_before", "verdict")


@query("fl13_page", oracle("job_events", STATE_SQL + """, f AS (SELECT * FROM state WHERE status = 'finished'), n AS (SELECT greatest(1, ceil(count(*) / 7)::INT) AS pages FROM f)
SELECT job_id, least(3, pages)::INT AS page, pages AS total_pages FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, job_id DESC) AS rn FROM f), n
WHERE rn > (least(3, pages) - 1) * 7 AND rn <= least(3, pages) * 7"""))
def _(spark, sf):
    return jb.page(state(spark, sf), "finished", 3, 7).select("job_id", "page", "total_pages")


def payload_jobs(spark, sf):
    """Jobs with a request payload and a stage map, as one row each."""
    ev = fx.job_events(spark, sf).withColumn("elapsed_s", F.col("elapsed_s") + 0.003)
    j = jb.stage_progress(ev).join(state(spark, sf), "job_id")
    k = F.col("job_id")
    payload = F.struct(
        F.concat(F.lit("https://v.example/"), k.cast("string")).alias("url"),
        F.when(k % 3 == 0, "review").when(k % 3 == 1, "dialogue").alias("mode"),
        F.when(k % 4 != 0, F.concat(F.lit("clip"), k.cast("string"))).alias("video_name"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "anna").alias("voice"),
        F.lit("news").alias("style"),
        F.lit("soft").alias("subtitle_mode"),
        F.lit("x").alias("heavy"),
    )
    return j.select("job_id", "status", "created_at", payload.alias("payload"), F.struct("stages").alias("result"))


PAYLOAD_SQL = """, p AS (SELECT job_id, status, 'https://v.example/' || job_id AS url, CASE job_id % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'dialogue' END AS mode,
  CASE WHEN job_id % 4 <> 0 THEN 'clip' || job_id END AS video_name, CASE job_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'anna' END AS voice, job_id % 7 = 0 AS ref_audio FROM state)"""


@query("fl14_list_jobs", oracle("job_events", STATE_SQL + STAGES_SQL + PAYLOAD_SQL + """ SELECT p.job_id, p.status, url, mode, video_name, voice, 'news' AS style, 'soft' AS subtitle_mode, round(nullif(round(sum(elapsed_s + 0.003), 1), 0), 4) AS total_elapsed_s
FROM p JOIN latest USING (job_id) GROUP BY ALL"""))
def _(spark, sf):
    return jb.list_jobs(payload_jobs(spark, sf)).select("job_id", "status", "payload.*", r4("total_elapsed_s").alias("total_elapsed_s"))


@query(
    "sc36_export_names",
    oracle("job_events", STATE_SQL + PAYLOAD_SQL + """ SELECT job_id, CASE WHEN video_name IS NOT NULL THEN concat_ws('_', mode, video_name) END AS output_stem,
 CASE WHEN ref_audio THEN 'cloned voice' ELSE coalesce(nullif(voice, ''), 'default') END AS voice_label FROM p"""),
)
def _(spark, sf):
    j = payload_jobs(spark, sf).select("job_id", "payload.*", (F.col("job_id") % 7 == 0).alias("ref_audio"))
    return jb.export_names(j).select("job_id", "output_stem", "voice_label")


@query("sr8_recent_jobs", oracle("job_events", STATE_SQL + " SELECT job_id, status FROM state ORDER BY created_at DESC, job_id DESC LIMIT 60"))
def _(spark, sf):
    return jb.recent_jobs(state(spark, sf), 60).select("job_id", "status")


@query(
    "jn10_plan_resume",
    oracle("job_events", STAGES_SQL + """, s AS (SELECT *, CASE WHEN job_id % 3 = 0 THEN 'c' || job_id END AS child_job_id FROM latest)
SELECT job_id, stage, CASE WHEN status = 'finished' AND job_id % 2 = 0 THEN 'reuse' WHEN status = 'started' AND child_job_id IS NOT NULL THEN 'reattach' ELSE 'run' END AS action FROM s"""),
)
def _(spark, sf):
    ev = fx.job_events(spark, sf)
    st = jb.stage_progress(ev).select("job_id", F.explode("stages").alias("stage", "e")).select("job_id", "stage", "e.status")
    st = st.withColumn("child_job_id", F.when(F.col("job_id") % 3 == 0, F.concat(F.lit("c"), F.col("job_id").cast("string"))))
    outputs = ev.filter(F.col("job_id") % 2 == 0).select("job_id", "stage")
    return jb.plan_resume(st, outputs).select("job_id", "stage", "action")


STAGE_NAMES_SQL = """, named AS (SELECT DISTINCT job_id, CASE stage WHEN 'signup' THEN 'download' WHEN 'view' THEN 'ocr_' || (k % 12) WHEN 'click' THEN (CASE WHEN job_id % 9 = 0 THEN 'tts' ELSE 'tts_seg_' || lpad((k % 30)::VARCHAR, 4, '0') END)
  WHEN 'purchase' THEN 'editor_edit' ELSE '_speaker_voice_map' END AS stage FROM job_events),
ranked AS (SELECT *, CASE WHEN stage = 'download' THEN 0 WHEN starts_with(stage, 'ocr') THEN 2 WHEN starts_with(stage, 'tts') THEN 4 WHEN stage = 'editor_edit' THEN 8 END AS rk,
  coalesce(nullif(regexp_extract(stage, '^(?:ocr|tts_seg)_([0-9]+)$', 1), '')::INT, -1) AS no FROM named)"""


@query("wn29_order_stages", oracle("job_events", STAGE_NAMES_SQL + " SELECT job_id, stage, row_number() OVER (PARTITION BY job_id ORDER BY rk, no, stage) AS position FROM ranked WHERE rk IS NOT NULL"))
def _(spark, sf):
    k = F.col("k")
    seg = F.when(F.col("job_id") % 9 == 0, "tts").otherwise(F.concat(F.lit("tts_seg_"), F.lpad((k % 30).cast("string"), 4, "0")))
    name = (
        F.when(F.col("stage") == "signup", "download")
        .when(F.col("stage") == "view", F.concat(F.lit("ocr_"), (k % 12).cast("string")))
        .when(F.col("stage") == "click", seg)
        .when(F.col("stage") == "purchase", "editor_edit")
        .otherwise("_speaker_voice_map")
    )
    return jb.order_stages(fx.job_events(spark, sf).select("job_id", name.alias("stage")).distinct())


@query(
    "fl15_validate_requests",
    """WITH o AS (SELECT o_orderkey AS request_id, ['review', 'book', 'mix', 'video', 'cartoon', 'mix'][(o_orderkey % 6 + 1)::INT] AS mode, CASE WHEN o_orderkey % 5 <> 0 THEN 'https://v.example/' || o_orderkey END AS url,
  o_orderkey % 4 AS docs, ['vi', 'en', 'xx'][(o_orderkey % 3 + 1)::INT] AS lang, o_orderkey AS k FROM orders),
x AS (SELECT *, CASE WHEN k % 7 = 0 THEN 0 ELSE 2 END AS nv, k % 11 = 0 AS badv, k % 2 = 0 AS img2, k % 13 = 0 AS noaud, k % 17 = 0 AS bada, k % 3 = 1 AS dur FROM o)
SELECT request_id, CASE WHEN mode = 'cartoon' THEN 'invalid mode' WHEN mode = 'book' AND docs = 0 THEN 'book needs documents' WHEN mode = 'book' AND lang = 'xx' THEN 'invalid ocr_lang'
  WHEN mode = 'mix' AND nv = 0 THEN 'mix needs video_items' WHEN mode = 'mix' AND noaud THEN 'mix needs audio_items' WHEN mode = 'mix' AND badv THEN 'invalid video item type'
  WHEN mode = 'mix' AND NOT img2 AND NOT dur THEN 'image among videos needs a duration' WHEN mode = 'mix' AND bada THEN 'invalid audio item type'
  WHEN mode NOT IN ('book', 'mix') AND url IS NULL THEN 'missing url' END AS error FROM x""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    item = lambda t, d: F.struct(t.alias("type"), d.cast("double").alias("duration"))
    pair = F.array(
        item(F.when(k % 11 == 0, "film").otherwise("image"), F.when(k % 3 == 1, 2.0)), item(F.when(k % 2 == 0, "image").otherwise("url"), F.lit(None))
    )
    modes = F.element_at(F.array(*[F.lit(m) for m in ["review", "book", "mix", "video", "cartoon", "mix"]]), (k % 6 + 1).cast("int"))
    req = fx.table(spark, sf, "orders").select(
        k.alias("request_id"),
        modes.alias("mode"),
        F.when(k % 5 != 0, F.concat(F.lit("https://v.example/"), k.cast("string"))).alias("url"),
        F.array_repeat(F.lit("d"), (k % 4).cast("int")).alias("documents"),
        F.element_at(F.array(F.lit("vi"), F.lit("en"), F.lit("xx")), (k % 3 + 1).cast("int")).alias("ocr_lang"),
        F.when(k % 7 != 0, pair).alias("video_items"),
        F.when(k % 13 != 0, F.array(item(F.when(k % 17 == 0, "image").otherwise("library"), F.lit(None)))).alias("audio_items"),
    )
    return jb.validate_requests(req).select("request_id", "error")


def mix_items(spark, sf):
    o, k = fx.ord_entries(spark, sf), F.col("id")
    return o.select(
        F.col("playlist_id").alias("job_id"),
        F.col("playlist_index").alias("idx"),
        F.when(k % 4 == 3, "a").otherwise("v").alias("side"),
        F.when((F.col("playlist_id") % 3 == 0) & (k % 5 == 0), "url").otherwise("image").alias("type"),
        F.when((k % 2 == 0) | (k % 4 == 3), (k % 40).cast("double")).alias("duration"),
    )


@query(
    "wn13_allocate_durations",
    oracle("ord_entries", """, i AS (SELECT playlist_id AS job_id, playlist_index AS idx, CASE WHEN id % 4 = 3 THEN 'a' ELSE 'v' END AS side, CASE WHEN playlist_id % 3 = 0 AND id % 5 = 0 THEN 'url' ELSE 'image' END AS type,
  CASE WHEN id % 2 = 0 OR id % 4 = 3 THEN (id % 40)::DOUBLE END AS duration FROM ord_entries),
g AS (SELECT job_id, bool_and(type = 'image') FILTER (side = 'v') AS images, coalesce(sum(duration) FILTER (side = 'v'), 0) AS fixed, count(*) FILTER (side = 'v' AND coalesce(duration, 0) = 0) AS n, sum(duration) FILTER (side = 'a') AS audio FROM i GROUP BY job_id)
SELECT job_id, idx, side, round(CASE WHEN side = 'v' AND coalesce(duration, 0) = 0 AND images AND audio > 0 THEN coalesce(nullif(greatest(audio - fixed, 0) / n, 0), 3.0) ELSE duration END, 4) AS duration FROM i JOIN g USING (job_id)"""),
)
def _(spark, sf):
    return jb.allocate_durations(mix_items(spark, sf)).select("job_id", "idx", "side", r4("duration").alias("duration"))


@query(
    "jn19_resolve_items",
    oracle("ord_entries", """, i AS (SELECT id, ['reuse', 'library', 'url', 'upload', 'image'][(id % 5 + 1)::INT] AS type, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'v' END AS side, id + 3 AS ref_job, title AS project, 't' || (id % 50) AS track,
  CASE WHEN id % 3 = 0 THEN 'https://v.example/' || id || ' shared' ELSE 'file' || id END AS ref, CASE WHEN id % 4 <> 0 THEN 2.0 END AS duration FROM ord_entries),
r AS (SELECT i.*, CASE type WHEN 'reuse' THEN '/out/' || o.id WHEN 'library' THEN CASE WHEN side = 'a' AND id % 50 < 25 THEN '/music/' || project || '/' || track END
  WHEN 'url' THEN nullif(regexp_extract(ref, 'https?://\\S+'), '') WHEN 'upload' THEN ref WHEN 'image' THEN CASE WHEN side = 'v' AND duration > 0 THEN ref END END AS source
  FROM i LEFT JOIN (SELECT id FROM ord_entries WHERE status = 'F') o ON i.ref_job = o.id)
SELECT id, type, source, CASE WHEN source IS NULL THEN 'unresolved ' || type END AS error FROM r""".replace("CASE WHEN side = 'a' AND id % 50 < 25", "CASE WHEN side = 'a' AND i.id % 50 < 25").replace("SELECT i.*, CASE type", "SELECT i.*, CASE i.type")),
)
def _(spark, sf):
    o, k = fx.ord_entries(spark, sf), F.col("id")
    text = k.cast("string")
    items = o.select(
        "id",
        F.element_at(F.array(*[F.lit(t) for t in ["reuse", "library", "url", "upload", "image"]]), (k % 5 + 1).cast("int")).alias("type"),
        F.when(k % 2 == 0, "a").otherwise("v").alias("side"),
        (k + 3).alias("ref_job"),
        F.col("title").alias("music_project"),
        F.concat(F.lit("t"), (k % 50).cast("string")).alias("music_track"),
        F.when(k % 3 == 0, F.concat(F.lit("https://v.example/"), text, F.lit(" shared"))).otherwise(F.concat(F.lit("file"), text)).alias("ref"),
        F.when(k % 4 != 0, 2.0).alias("duration"),
    )
    outputs = o.filter(F.col("status") == "F").select(k.alias("job_id"), F.concat(F.lit("/out/"), text).alias("path"))
    tracks = o.filter(k % 50 < 25).select(F.col("title").alias("project"), F.concat(F.lit("t"), (k % 50).cast("string")).alias("track")).distinct()
    return jb.resolve_items(items, outputs, tracks).select("id", "type", "source", "error")


@query(
    "st9_chat_offsets",
    oracle("ev_intervals", """, a AS (SELECT media_id, event_id AS seq, CASE WHEN category IN ('view', 'click', 'signup') THEN (start_us // 1000)::BIGINT END AS offset_ms FROM ev_intervals)
SELECT media_id, seq, coalesce(last_value(offset_ms IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS offset_ms FROM a"""),
)
def _(spark, sf):
    iv = fx.ev_intervals(spark, sf)
    ms = F.floor(F.round(F.col("start_time") * 1000000).cast("bigint") / 1000)
    acts = iv.select("media_id", F.col("event_id").alias("seq"), F.when(F.col("category").isin("view", "click", "signup"), ms).alias("offset_ms"), F.col("category").alias("action"))
    return jb.chat_offsets(acts).select("media_id", "seq", "offset_ms")


@query("st10_progress")
def _(spark, sf):
    iv = fx.ev_intervals(spark, sf)
    up = iv.select(
        F.col("media_id").alias("job_id"), "event_id", (F.col("start_time") / 20000).alias("t"), (F.col("end_time") - F.col("start_time")).alias("size"), F.lit(3000.0).alias("total")
    )
    out = jb.progress(up)
    return out.select("job_id", "event_id", *[F.round(c, 4).alias(c) for c in ("downloaded", "speed", "eta")])
