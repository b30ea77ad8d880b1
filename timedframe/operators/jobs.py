"""Job events: state, stages, depth, liveness, usage, limits and retention, in batch form.

Event tables carry ``event_id, ts, job_id, status`` and optional ``stage, elapsed_s``.  "Now" and
"today" are always parameters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.operators.ordered import attach_group, fits, lag_lead, last_per_key, number_rows, run_last, run_sum, scan
from timedframe.semantics import blank, secs

# Fixed values
TRANSITIONS = {
    "pending": ["started", "cancelled"],
    "started": ["finished", "failed", "cancelled"],
    "failed": ["pending"],
    "cancelled": ["pending"],
}
STATE_TTL_S = 48 * 3600
BEAT_TTL_S = 30
RECENT_CAP = 200
PAGE_SIZE = 10
STAGE_ORDER = [
    "download", "transcribe", "ocr", "translate", "tts",
    "editor_srt", "editor_mix_dialogue", "editor_mix_music", "editor_edit",
]
MODES = ["review", "dialogue", "subtitle", "audio", "video", "book", "mix"]
OCR_LANGS = ["vi", "en", "fr"]
VIDEO_ITEM_TYPES = ["url", "upload", "reuse", "image"]
AUDIO_ITEM_TYPES = ["url", "upload", "reuse", "library"]
POLL_S = 2.0
MAX_WAIT_S = 300.0
IMAGE_FALLBACK_S = 3.0
RETENTION_DAYS = 2
SAMPLING_WINDOW_S = 3.0
SAMPLING_RATE_S = 0.05
GRACE_S = 1.0
SPEED_SMOOTHING = 0.7
ETA_SMOOTHING = 0.9


# ---- state ---------------------------------------------------------------------------------------


def job_state(events: DataFrame) -> DataFrame:
    """Latest state per job: the last event by (ts, event_id) wins, whatever order events arrive in."""
    at = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.count_if(F.col("status") == "pending").alias("submissions"),
    )


def transition_audit(events: DataFrame) -> DataFrame:
    """Each event with the status before it and whether that move is an allowed one."""
    rows = lag_lead(events, ["job_id"], ["ts", "event_id"], lags={"from_status": F.col("status")})
    ok = F.col("from_status").isNull() & (F.col("status") == "pending")
    for before, after in TRANSITIONS.items():
        ok = ok | ((F.col("from_status") == before) & F.col("status").isin(after))
    return rows.withColumn("allowed", F.coalesce(ok, F.lit(False)))


def queue_depth(state: DataFrame, service: str = "service") -> DataFrame:
    return state.groupBy(service).agg(
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "started").alias("processing")
    )


def total_jobs(events: DataFrame) -> DataFrame:
    return events.select("job_id").distinct().agg(F.count("*").alias("total_jobs"))


def _starts(today: str) -> dict[str, Column]:
    day = F.lit(today).cast("date")
    return {"today": day, "this_week": F.trunc(day, "week"), "this_month": F.trunc(day, "month")}


def finished_since(state: DataFrame, today: str) -> DataFrame:
    done = F.col("status") == "finished"
    when = F.to_date("updated_at")
    return state.agg(*[F.count_if(done & (when >= start)).alias(n) for n, start in _starts(today).items()])


def token_stats(usage: DataFrame, today: str, value: str = "tokens") -> DataFrame:
    """Daily sums first, then independent roll-ups of today, this week (from Monday) and this month."""
    daily = usage.groupBy(F.to_date("ts").alias("day")).agg(F.sum(value).alias("tokens"))
    day = F.lit(today).cast("date")
    return daily.agg(
        *[
            F.coalesce(F.sum(F.when((F.col("day") >= start) & (F.col("day") <= day), F.col("tokens"))), F.lit(0)).alias(n)
            for n, start in _starts(today).items()
        ]
    )


def usage_summary(calls: DataFrame, key: str = "job_id") -> DataFrame:
    """Prompt, completion and total tokens plus a map of calls per model."""
    per_model = calls.groupBy(key, "model").agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("p"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("c"), F.count("*").alias("n")
    )
    return per_model.groupBy(key).agg(
        F.sum("p").alias("prompt_tokens"),
        F.sum("c").alias("completion_tokens"),
        (F.sum("p") + F.sum("c")).alias("total_tokens"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("calls_by_model"),
    )


# ---- stages --------------------------------------------------------------------------------------


def stage_progress(events: DataFrame) -> DataFrame:
    """Stage map per job (latest entry per stage) with the current stage and when it began."""
    at = F.struct("ts", "event_id")
    entry = F.struct("status", "elapsed_s")
    latest = events.groupBy("job_id", "stage").agg(F.max_by(entry, at).alias("entry"), F.max(at).alias("at"))
    return latest.groupBy("job_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "entry")))).alias("stages"),
        F.max_by("stage", "at").alias("current_stage"),
        F.max("at")["ts"].alias("current_stage_at"),
    )


def stage_elapsed(jobs: DataFrame, stages: str = "stages") -> DataFrame:
    """Total elapsed seconds over the stage map, one decimal; resumed stages count 0 and a zero total is NULL."""
    fields = jobs.schema[stages].dataType.valueType.names
    live = (lambda s: F.when(F.coalesce(s["resumed"], F.lit(False)), F.lit(0.0)).otherwise(s["elapsed_s"])) if "resumed" in fields else (lambda s: s["elapsed_s"])
    total = F.aggregate(F.map_values(stages), F.lit(0.0), lambda a, s: a + F.coalesce(live(s), F.lit(0.0)))
    return jobs.withColumn("total_elapsed_s", F.nullif(F.round(total, 1), F.lit(0.0)))


def order_stages(stages: DataFrame, order: Sequence[str] = STAGE_ORDER) -> DataFrame:
    """Display order: the stages of ``order``, with numbered ``ocr_N`` / ``tts_seg_N`` groups sorted in their place.

    A plain ``ocr`` or ``tts`` replaces its numbered group; names outside the list are not shown.
    """
    rank = None
    for i, name in enumerate(order):
        hit = F.col("stage") == name
        if name == "ocr":
            hit = hit | F.col("stage").rlike("^ocr_[0-9]+$")
        if name == "tts":
            hit = hit | F.col("stage").rlike("^tts_seg_[0-9]+$")
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    number = F.regexp_extract("stage", r"^(?:ocr|tts_seg)_([0-9]+)$", 1).try_cast("int")
    rows = stages.withColumn("_rank", rank).withColumn("_no", number).filter(F.col("_rank").isNotNull())
    rows = attach_group(rows, ["job_id"], _ocr=F.max(F.col("stage") == "ocr"), _tts=F.max(F.col("stage") == "tts"))
    hidden = (F.col("_ocr") & F.col("stage").startswith("ocr_")) | (F.col("_tts") & F.col("stage").startswith("tts_seg_"))
    rows = rows.filter(~hidden).withColumn("_no", F.coalesce("_no", F.lit(-1)))
    return number_rows(rows, ["job_id"], ["_rank", "_no", "stage"], "position").select(*stages.columns, "position")


def plan_resume(stages: DataFrame, outputs: DataFrame) -> DataFrame:
    """reuse a finished stage whose output exists, reattach a started one with a child job, else run."""
    have = outputs.select("job_id", "stage").distinct().withColumn("_out", F.lit(True))
    rows = stages.join(have, ["job_id", "stage"], "left")
    action = (
        F.when((F.col("status") == "finished") & F.col("_out"), "reuse")
        .when((F.col("status") == "started") & F.col("child_job_id").isNotNull(), "reattach")
        .otherwise("run")
    )
    return rows.withColumn("action", action).select(*stages.columns, "action")


# ---- listings ------------------------------------------------------------------------------------


def recent_jobs(jobs: DataFrame, n: int = 50, most: int | None = RECENT_CAP) -> DataFrame:
    """The ``n`` newest jobs, but no more than ``most`` (None for no such bound)."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(n if most is None else min(n, most))


def list_jobs(jobs: DataFrame) -> DataFrame:
    """Listing projection: six payload fields and the elapsed total, without the heavy result."""
    total = F.round(F.aggregate(F.map_values("result.stages"), F.lit(0.0), lambda a, s: a + F.coalesce(s["elapsed_s"], F.lit(0.0))), 1)
    payload = F.struct(*[F.col(f"payload.{f}").alias(f) for f in ["url", "mode", "video_name", "voice", "style", "subtitle_mode"]])
    return jobs.select("job_id", "status", payload.alias("payload"), F.nullif(total, F.lit(0.0)).alias("total_elapsed_s"))


def page(jobs: DataFrame, status: str, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of jobs of a status (or ``all``), newest first; the page number is clamped."""
    rows = jobs if status == "all" else jobs.filter(F.col("status") == status)
    pages = max(1, -(-rows.count() // size))
    at = max(1, min(number, pages))
    rows = rows.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).offset((at - 1) * size).limit(size)
    return rows.withColumns({"page": F.lit(at), "total_pages": F.lit(pages)})


def export_names(jobs: DataFrame) -> DataFrame:
    """Output stem and voice label from the job's payload."""
    name, mode = F.nullif("video_name", F.lit("")), F.nullif("mode", F.lit(""))
    stem = F.when(name.isNotNull(), F.concat_ws("_", mode, name))
    label = F.when(F.col("ref_audio"), "cloned voice").otherwise(F.coalesce(F.nullif("voice", F.lit("")), F.lit("default")))
    return jobs.withColumns({"output_stem": stem, "voice_label": label})


def validate_requests(requests: DataFrame) -> DataFrame:
    """First failing rule per request as ``error`` (NULL when valid).

    Columns: mode, url, documents array, ocr_lang, video_items and audio_items arrays of (type, duration).
    """
    items = lambda c: F.coalesce(F.col(c), F.expr("array()").cast("array<struct<type:string,duration:double>>"))
    v, a = items("video_items"), items("audio_items")
    mode = F.col("mode")
    bad_video = F.exists(v, lambda i: ~F.coalesce(i["type"].isin(VIDEO_ITEM_TYPES), F.lit(False)))
    bad_audio = F.exists(a, lambda i: ~F.coalesce(i["type"].isin(AUDIO_ITEM_TYPES), F.lit(False)))
    only_images = F.forall(v, lambda i: i["type"] == "image")
    needs_time = ~only_images & F.exists(v, lambda i: (i["type"] == "image") & ~F.coalesce(i["duration"] > 0, F.lit(False)))
    book, mix = mode == "book", mode == "mix"
    error = (
        F.when(~F.coalesce(mode.isin(MODES), F.lit(False)), "invalid mode")
        .when(book & (F.coalesce(F.size("documents"), F.lit(0)) <= 0), "book needs documents")
        .when(book & ~F.coalesce(F.col("ocr_lang").isin(OCR_LANGS), F.lit(False)), "invalid ocr_lang")
        .when(mix & (F.size(v) == 0), "mix needs video_items")
        .when(mix & (F.size(a) == 0), "mix needs audio_items")
        .when(mix & bad_video, "invalid video item type")
        .when(mix & needs_time, "image among videos needs a duration")
        .when(mix & bad_audio, "invalid audio item type")
        .when(~book & ~mix & blank("url"), "missing url")
    )
    return requests.withColumn("error", error)


def resolve_items(items: DataFrame, outputs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Source of each mix item by type; what cannot be found gets an ``error``.  A job with several outputs gives its last path."""
    paths = last_per_key(outputs.select(F.col("job_id").alias("ref_job"), F.col("path").alias("_out")), ["ref_job"])
    known = tracks.select(F.col("project").alias("music_project"), F.col("track").alias("music_track"), F.lit(True).alias("_track")).distinct()
    out = items.join(paths, "ref_job", "left").join(known, ["music_project", "music_track"], "left")
    kind = F.col("type")
    found = (
        F.when(kind == "reuse", F.col("_out"))
        .when((kind == "library") & (F.col("side") == "a") & F.col("_track"), F.concat_ws("/", F.lit("/music"), "music_project", "music_track"))
        .when(kind == "url", F.nullif(F.regexp_extract("ref", r"https?://\S+", 0), F.lit("")))
        .when(kind.isin("upload") | ((kind == "image") & (F.col("side") == "v") & (F.col("duration") > 0)), F.col("ref"))
    )
    return out.withColumn("source", found).withColumn("error", F.when(F.col("source").isNull(), F.concat(F.lit("unresolved "), kind))).select(*items.columns, "source", "error")


def allocate_durations(items: DataFrame) -> DataFrame:
    """When all video items of a job are images, those without a duration share the leftover audio time."""
    video = F.col("side") == "v"
    unset = F.coalesce(F.col("duration"), F.lit(0.0)) == 0
    rows = attach_group(
        items,
        ["job_id"],
        _images=F.min(F.when(video, F.col("type") == "image")),
        _fixed=F.coalesce(F.sum(F.when(video, F.col("duration"))), F.lit(0.0)),
        _open=F.count_if(video & unset),
        _audio=F.sum(F.when(~video, F.col("duration"))),
    )
    share = F.greatest(F.col("_audio") - F.col("_fixed"), F.lit(0.0)) / F.nullif("_open", F.lit(0))
    share = F.when(share == 0, F.lit(IMAGE_FALLBACK_S)).otherwise(share)
    fill = video & unset & F.col("_images") & (F.col("_audio") > 0)
    return rows.select(*[F.when(fill, share).otherwise(F.col("duration")).alias(c) if c == "duration" else F.col(c) for c in items.columns])


# ---- liveness and recovery -----------------------------------------------------------------------


def liveness(beats: DataFrame, now: str, key: str = "worker") -> DataFrame:
    last = beats.groupBy(key).agg(F.max("ts").alias("last_beat"))
    return last.withColumn("alive", secs(F.lit(now).cast("timestamp")) - secs("last_beat") <= BEAT_TTL_S)


def node_status(beats: DataFrame, depth: DataFrame, now: str) -> DataFrame:
    alive = liveness(beats, now, "service").select("service", "alive")
    return alive.join(depth, "service", "full").select(
        "service", F.coalesce("alive", F.lit(False)).alias("alive"), F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("processing", F.lit(0)).alias("processing")
    )


def stale_jobs(state: DataFrame, alive_workers: DataFrame) -> DataFrame:
    """Jobs still in processing whose worker is gone; they go back to the head of the queue, oldest first."""
    stuck = state.filter(F.col("status") == "started").join(alive_workers.select("worker").distinct(), "worker", "left_anti")
    return number_rows(stuck, ["worker"], ["updated_at", "job_id"], "requeue_position").withColumn("status", F.lit("pending"))


def flag_ratio(segments: DataFrame, thr: float = 0.5, key: str = "media_id") -> DataFrame:
    hits = F.count_if(F.col("residual_risk") > thr)
    return segments.groupBy(key).agg(hits.alias("flagged"), F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)).alias("ratio"))


def dispatch_summary(results: DataFrame, key: str = "job_id") -> DataFrame:
    return results.groupBy(key).agg(F.bool_or("ok").alias("ok"), F.count_if("ok").alias("sent"), F.count("*").alias("total"))


def daily_tokens(usage: DataFrame, value: str = "tokens") -> DataFrame:
    return usage.groupBy(F.to_date("ts").alias("day")).agg(F.sum(value).alias("tokens"))


def throughput(events: DataFrame) -> DataFrame:
    """Finished events per day, week and month: one pass to days, then roll-ups of the small daily table."""
    return roll_up(events.filter(F.col("status") == "finished").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("finished")))


def roll_up(daily: DataFrame) -> DataFrame:
    """Sums of ``finished`` per day, week and month, from rows per day."""
    spans = F.explode(
        F.array(
            *[F.struct(F.lit(unit).alias("unit"), F.to_date(F.date_trunc(unit, F.col("day"))).alias("period")) for unit in ["day", "week", "month"]]
        )
    )
    return daily.select(spans.alias("s"), "finished").groupBy("s.unit", "s.period").agg(F.sum("finished").alias("finished"))


def prune(logs: DataFrame, today: str, days: int = RETENTION_DAYS, name: str = "date") -> DataFrame:
    """Rows of partitions not older than ``days``; names that are no dates stay."""
    day = F.try_to_date(F.col(name), "yyyy-MM-dd")
    return logs.filter(F.coalesce(day >= F.date_sub(F.lit(today).cast("date"), days), F.lit(True)))


def apply_cancels(events: DataFrame, cancels: DataFrame) -> DataFrame:
    """State of each job when its cancel arrives: pending is cancelled at once, started is cancelling."""
    both = events.select("job_id", "ts", "event_id", "status", F.lit(0).alias("_cancel")).unionByName(
        cancels.select("job_id", "ts", F.col("cancel_id").alias("event_id"), F.lit(None).cast("string").alias("status"), F.lit(1).alias("_cancel"))
    )
    rows = scan(both, ["job_id"], ["ts", "_cancel", "event_id"], {"state_before": run_last(F.col("status"))})
    verdict = F.when(F.col("state_before") == "pending", "cancelled").when(F.col("state_before") == "started", "cancelling").otherwise("rejected")
    return rows.filter(F.col("_cancel") == 1).select("job_id", F.col("event_id").alias("cancel_id"), "ts", "state_before", verdict.alias("verdict"))


# ---- rate limits ---------------------------------------------------------------------------------


def rate_violations(requests: DataFrame, max_requests: int, window_s: float, key: str = "domain") -> DataFrame:
    """Requests that find more than ``max_requests`` (itself and all of the same instant included) in the trailing window.

    The requests of an instant add their number at its time and take it away a window later; a running sum of
    these steps is the live count, so no pair of requests is ever formed.
    """
    width = int(round(window_s * 1_000_000))
    timed = requests.select(key, "event_id", F.unix_micros("ts").alias("_t"))
    add = timed.groupBy(key, "_t").agg(F.count("*").alias("_step"))
    drop = add.select(key, (F.col("_t") + width).alias("_t"), (-F.col("_step")).alias("_step"))
    rows = scan(add.unionByName(drop), [key], ["_t", "_step"], {"in_window": run_sum(F.col("_step"))})
    busy = rows.filter((F.col("_step") > 0) & (F.col("in_window") > max_requests)).select(F.col(key).alias("_k"), F.col("_t").alias("_kt"), "in_window")
    return timed.join(busy, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_kt"))).select(key, "event_id", "in_window")


def rate_limit(requests: DataFrame, max_requests: int, window_s: float, key: str = "domain") -> DataFrame:
    """Replay of the sliding-window limiter: admit, or poll every 2 s up to 300 s, then admit with a warning.

    A quiet stretch longer than window plus longest wait resets a domain, so each busy session replays on
    its own; sessions, not domains, are spread over tasks and streamed in time order.
    """
    small = fits(requests, [key])
    rows = lag_lead(requests.select(key, "event_id", secs("ts").alias("t")), [key], ["t", "event_id"], lags={"_pt": F.col("t")}, bounded=small)
    fresh = F.when(F.col("t") - F.col("_pt") <= window_s + MAX_WAIT_S, 0).otherwise(1)
    rows = scan(rows, [key], ["t", "event_id"], {"_session": run_sum(fresh)}, small)
    rows = rows.repartition(key, "_session").sortWithinPartitions(key, "_session", "t", "event_id")
    kind = dict(rows.dtypes)[key]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from timedframe.functions.limiter import Limiter

        current, limiter = None, None
        for pdf in batches:
            out = []
            for k, event_id, t, session in zip(*(pdf[c].tolist() for c in (key, "event_id", "t", "_session"))):
                if (k, session) != current:
                    if limiter:
                        out.extend((current[0], *r) for r in limiter.finish())
                    current, limiter = (k, session), Limiter(max_requests, window_s, POLL_S, MAX_WAIT_S)
                out.extend((k, *r) for r in limiter.offer(t, event_id))
            yield pd.DataFrame(out, columns=[key, "event_id", "admitted_at", "waited_s", "warned"])
        if limiter:
            yield pd.DataFrame([(current[0], *r) for r in limiter.finish()], columns=[key, "event_id", "admitted_at", "waited_s", "warned"])

    return rows.mapInPandas(replay, f"{key} {kind}, event_id bigint, admitted_at double, waited_s double, warned boolean")


# ---- chat and progress ---------------------------------------------------------------------------


def chat_offsets(actions: DataFrame) -> DataFrame:
    """Offset in ms per action; actions without a time carry the last offset of their media."""
    rows = scan(actions, ["media_id"], ["seq"], {"_last": run_last(F.col("offset_ms"))})
    return rows.select("media_id", "seq", F.coalesce("_last", F.lit(0)).alias("offset_ms"), "action")


def progress(updates: DataFrame, key: str = "job_id") -> DataFrame:
    """Smoothed speed and ETA after each update (``key, event_id, t, size, total``).

    A silence longer than the sampling window resets the smoothing, so the stretches between silences are
    independent; the running size and the start time come from Spark, only the smoothing is sequential.
    """
    rows = updates.select(key, "event_id", "t", "size", "total")
    small = fits(updates, [key])
    rows = scan(rows, [key], ["t", "event_id"], {"_done": run_sum(F.col("size"))}, small)
    rows = attach_group(rows, [key], _t0=F.min("t"))
    rows = lag_lead(rows, [key], ["t", "event_id"], lags={"_pt": F.col("t")}, bounded=small)
    rows = scan(rows, [key], ["t", "event_id"], {"_session": run_sum(F.when(F.col("t") - F.col("_pt") > SAMPLING_WINDOW_S, 1).otherwise(0))}, small)
    rows = rows.repartition(key, "_session").sortWithinPartitions(key, "_session", "t", "event_id")
    kind = dict(rows.dtypes)[key]

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from timedframe.functions.progress import Progress

        current, state = None, None
        for pdf in batches:
            out = []
            for k, e, t, done, total, t0, session in zip(*[pdf[c] for c in (key, "event_id", "t", "_done", "total", "_t0", "_session")]):
                if (k, session) != current:
                    current, state = (k, session), Progress(t0, None if session == 0 else t)
                speed, eta = state.feed(t, done, None if pd.isna(total) else total)
                out.append((k, e, done, speed, eta))
            yield pd.DataFrame(out, columns=[key, "event_id", "downloaded", "speed", "eta"])

    return rows.mapInPandas(smooth, f"{key} {kind}, event_id bigint, downloaded double, speed double, eta double")
