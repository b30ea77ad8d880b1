"""Streaming queries over the event table, drained once and checked against their batch twins' oracles."""

from pyspark.sql import functions as F

from timedframe import fixtures as fx
from timedframe.fixtures import oracle
from timedframe.registry.core import query
from timedframe.registry.jobs import STAGES_SQL, STATE_SQL
from timedframe.streaming import jobs as sj
from timedframe.operators.jobs import roll_up
from timedframe.streaming.run import drain, drain_merged, read_stream


def events(spark, sf):
    return read_stream(spark, sf, "events.parquet")


def job_events(spark, sf):
    return events(spark, sf).select(
        "event_id", "ts", F.col("user_id").alias("job_id"), fx.status_of(F.col("event_type")).alias("status"), F.col("event_type").alias("stage"),
        F.col("value").alias("elapsed_s"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )


@query("st1_stream_job_state", oracle("job_events", STATE_SQL + " SELECT job_id, status, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us, submissions FROM state"))
def _(spark, sf):
    return drain_merged(sj.job_state(job_events(spark, sf)), "job_state", ["job_id"])


@query("st2_stream_stage_progress", oracle("job_events", STAGES_SQL + " SELECT job_id, stage, status, elapsed_s, last_value(stage) OVER (PARTITION BY job_id ORDER BY seen ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current_stage FROM latest"))
def _(spark, sf):
    jobs = drain_merged(sj.stage_progress(job_events(spark, sf)), "stage_progress", ["job_id"])
    return jobs.select("job_id", "current_stage", F.explode("stages").alias("stage", "entry")).select("job_id", "stage", "entry.status", "entry.elapsed_s", "current_stage")


@query(
    "st3_stream_last_beats",
    "WITH b AS (SELECT user_id AS worker, max(ts) AS last FROM events GROUP BY 1) SELECT worker, epoch_us(last) AS last_us, epoch_us((SELECT max(last) FROM b)) - epoch_us(last) <= 30000000 AS alive FROM b",
)
def _(spark, sf):
    last = drain_merged(sj.last_beats(events(spark, sf).select(F.col("user_id").alias("worker"), "ts")), "last_beats", ["worker"])
    now = last.agg(F.max("last_beat").alias("now"))
    return sj.alive_at(last.crossJoin(F.broadcast(now)), F.col("now")).select("worker", F.unix_micros("last_beat").alias("last_us"), "alive")


@query("st3_stream_liveness")
def _(spark, sf):
    beats = events(spark, sf).select(F.col("user_id").alias("worker"), "ts")
    return drain(sj.liveness(beats), "liveness")


@query("st5_stream_rate_limit")
def _(spark, sf):
    req = events(spark, sf).select(F.col("event_type").alias("domain"), "event_id", "ts")
    out = drain(sj.rate_limit(req, 5, 600.0), "rate_limit")
    return out.select("domain", "event_id", F.round("admitted_at", 3).alias("admitted_at"), F.round("waited_s", 3).alias("waited_s"), "warned")


@query("st7_stream_daily_tokens", oracle("job_events", "SELECT strftime(ts, '%Y-%m-%d') AS day, sum(k)::BIGINT AS tokens FROM job_events GROUP BY 1"))
def _(spark, sf):
    return drain_merged(sj.daily_tokens(job_events(spark, sf)), "daily_tokens", ["day"]).select(F.col("day").cast("string").alias("day"), "tokens")


@query(
    "st13_stream_throughput",
    oracle("job_events", """, f AS (SELECT ts FROM job_events WHERE status = 'finished')
SELECT unit, strftime(date_trunc(unit, ts), '%Y-%m-%d') AS period, count(*) AS finished FROM f, (VALUES ('day'), ('week'), ('month')) u(unit) GROUP BY 1, 2"""),
)
def _(spark, sf):
    days = drain_merged(sj.throughput(job_events(spark, sf)), "throughput", ["day"])
    return roll_up(days).select("unit", F.col("period").cast("string").alias("period"), "finished")


@query(
    "st12_stream_apply_cancels",
    oracle("job_events", """, c AS (SELECT user_id AS job_id, event_id AS cancel_id, ts + INTERVAL 1 SECOND AS ts FROM events WHERE event_id % 7 = 0)
SELECT c.job_id, c.cancel_id, e.status AS state_before, CASE e.status WHEN 'pending' THEN 'cancelled' WHEN 'started' THEN 'cancelling' ELSE 'rejected' END AS verdict
FROM c ASOF LEFT JOIN job_events e ON c.job_id = e.job_id AND c.ts >= e.ts"""),
)
def _(spark, sf):
    ev = job_events(spark, sf)
    cancels = ev.filter(F.col("event_id") % 7 == 0).select("job_id", F.col("event_id").alias("cancel_id"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"))
    return drain(sj.apply_cancels(ev, cancels), "cancels")


@query(
    "st9_stream_chat_offsets",
    """WITH a AS (SELECT user_id AS media_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click', 'signup') THEN epoch_us(ts) // 1000 - 1704067200000 END AS offset_ms FROM events)
SELECT media_id, seq, coalesce(last_value(offset_ms IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS offset_ms FROM a""",
)
def _(spark, sf):
    ms = F.unix_millis("ts") - F.lit(1704067200000)
    acts = events(spark, sf).select(F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type").isin("view", "click", "signup"), ms).alias("offset_ms"))
    return drain(sj.chat_offsets(acts), "chat")


@query("st10_stream_progress")
def _(spark, sf):
    t = (F.unix_micros("ts") - F.lit(1704067200000000)) / F.lit(2e10)
    up = events(spark, sf).select(F.col("user_id").alias("job_id"), "event_id", "ts", t.alias("t"), F.col("value").alias("size"), F.lit(3000.0).alias("total"))
    out = drain(sj.progress(up), "progress")
    return out.select("job_id", "event_id", *[F.round(c, 4).alias(c) for c in ("downloaded", "speed", "eta")])


@query("st8_stream_dedup_cues")
def _(spark, sf):
    start = F.floor(F.unix_seconds("ts") / 3600) * 3600
    cues = events(spark, sf).select(
        F.col("user_id").alias("media_id"), F.lit("").alias("id"), start.cast("bigint").alias("start"), (start + 3600).cast("bigint").alias("end"),
        F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("text"), F.lit("").alias("settings"), (start + 3600).cast("timestamp").alias("ts"),
    )
    return drain(sj.dedup_cues(cues), "cues").select("media_id", "text", "start", "end")
