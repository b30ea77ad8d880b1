"""Streaming forms of the event operators.  Each has a batch twin in ``operators`` with the same result.

All take a streaming (or batch-shaped) table with an event-time column ``ts`` and set their own watermark.
State per key is small and fixed in shape.  Where the result depends on order, rows of a key within one trigger are put in event
order first.  Streams in update mode are kept by ``run.Merged``, which holds windows and keys that are still open.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timedframe.operators.jobs import BEAT_TTL_S, MAX_WAIT_S, POLL_S, STATE_TTL_S
from timedframe.streaming.processors import JobState, OpenCue, StageMap

APPEND = "append"
#: Rows of a result that a stateful function gives out at a time.
OUT_ROWS = 10_000


def _ordered(batches: Iterable[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


def _sorted_pairs(batches: Iterable[pd.DataFrame], first: str, second: str, rows: int = 10_000) -> Iterator[tuple[int, int]]:
    """Pairs of two whole-number columns in order.  16 bytes a row are held and as many more while they are sorted."""
    parts = [[p[c].to_numpy(dtype="int64", copy=True) for c in (first, second)] for p in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((b, a))
    for i in range(0, len(order), rows):
        at = order[i : i + rows]
        yield from zip(a[at].tolist(), b[at].tolist())


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("us", F.unix_micros("ts"))


# ---- job and stage state -------------------------------------------------------------------------


def _processed(events: DataFrame, columns: list[str], processor, watermark: str) -> DataFrame:
    rows = _micros(events.select(*columns).withWatermark("ts", watermark))
    return rows.groupBy("job_id").transformWithState(processor, processor.OUTPUT, "Update", "EventTime")


def job_state(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The state of each job that a trigger changes (update mode); an older event never overwrites a newer one.

    State is dropped 48 hours after a job's last event.
    """
    return _processed(events, ["job_id", "event_id", "ts", "status"], JobState(), watermark)


def stage_progress(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The stage map of each job that a trigger changes (update mode), with status and elapsed time of every stage."""
    return _processed(events, ["job_id", "event_id", "ts", "stage", "status", "elapsed_s"], StageMap(), watermark)


def last_beats(beats: DataFrame, key: str = "worker", watermark: str = "30 seconds") -> DataFrame:
    """The last beat of each worker that a trigger changes (update mode); ``alive_at`` reads who is alive from the merged table."""
    return beats.withWatermark("ts", watermark).groupBy(key).agg(F.max("ts").alias("last_beat"))


def alive_at(last: DataFrame, now: Column) -> DataFrame:
    """Each worker with whether its last beat is at most 30 s before ``now``."""
    return last.withColumn("alive", F.unix_micros(now) - F.unix_micros("last_beat") <= BEAT_TTL_S * 1_000_000)


def liveness(beats: DataFrame, watermark: str = "30 seconds") -> DataFrame:
    """A row when a worker comes alive and when 30 s of event time pass without a beat."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], last, False)], columns=["worker", "last_us", "alive"])
            return
        fresh = not state.exists
        last = max([int(p["us"].max()) for p in batches] + ([] if fresh else [state.get[0]]))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + BEAT_TTL_S * 1000, state.getCurrentWatermarkMs() + 1))
        if fresh:
            yield pd.DataFrame([(key[0], last, True)], columns=["worker", "last_us", "alive"])

    return (
        _micros(beats.select("worker", "ts").withWatermark("ts", watermark))
        .groupBy("worker")
        .applyInPandasWithState(update, "worker bigint, last_us bigint, alive boolean", "last bigint", APPEND, GroupStateTimeout.EventTimeTimeout)
    )


def apply_cancels(events: DataFrame, cancels: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Verdict on each cancel from the job's state at that time; both inputs share one watermark."""
    both = events.select("job_id", "ts", "event_id", "status", F.lit(0).alias("cancel")).unionByName(
        cancels.select("job_id", "ts", F.col("cancel_id").alias("event_id"), F.lit(None).cast("string").alias("status"), F.lit(1).alias("cancel"))
    )

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, us = state.get if state.exists else (None, 0)
        out = []
        for u, c, e, s in _ordered(batches, ["us", "cancel", "event_id"])[["us", "cancel", "event_id", "status"]].itertuples(index=False):
            us = max(us, int(u))
            if c:
                verdict = {"pending": "cancelled", "started": "cancelling"}.get(status, "rejected")
                out.append((key[0], int(e), status, verdict))
            else:
                status = s
        state.update((status, us))
        state.setTimeoutTimestamp(max(us // 1000 + STATE_TTL_S * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "cancel_id", "state_before", "verdict"])

    return (
        _micros(both.withWatermark("ts", watermark))
        .groupBy("job_id")
        .applyInPandasWithState(
            update, "job_id bigint, cancel_id bigint, state_before string, verdict string", "status string, us bigint", APPEND, GroupStateTimeout.EventTimeTimeout
        )
    )


# ---- windows -------------------------------------------------------------------------------------


def daily_tokens(usage: DataFrame, value: str = "tokens", watermark: str = "1 day") -> DataFrame:
    """Tokens per day: in update mode each trigger gives the days that it changes, in append mode days that are closed."""
    days = usage.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day")).agg(F.sum(value).alias("tokens"))
    return days.select(F.to_date("window.start").alias("day"), "tokens")


def throughput(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Finished jobs per day, in update mode the days that a trigger changes; weeks and months are sums of the merged days."""
    done = events.filter(F.col("status") == "finished").withWatermark("ts", watermark)
    return done.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("finished")).select(F.to_date("window.start").alias("day"), "finished")


# ---- limiter, progress, chat, cues ---------------------------------------------------------------


def rate_limit(requests: DataFrame, max_requests: int, window_s: float, watermark: str = "10 minutes") -> DataFrame:
    """Admissions of the sliding-window limiter.  State per domain: admitted times in the window and the waiting requests."""
    columns = ["domain", "event_id", "admitted_at", "waited_s", "warned"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from timedframe.functions.limiter import Limiter

        lim = Limiter(max_requests, window_s, POLL_S, MAX_WAIT_S)
        last = 0.0
        if state.exists:
            admitted, at, ids, arrived, last = state.get
            lim.admitted, lim.waiting = deque(admitted), sorted(zip(at, ids, arrived))
        out = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() / 1000
            out.extend((key[0], *r) for r in lim.advance(now))
            if not lim.waiting and now >= last + window_s + MAX_WAIT_S:
                state.remove()
                yield pd.DataFrame(out, columns=columns)
                return
        for u, e in _sorted_pairs(batches, "us", "event_id") if not state.hasTimedOut else ():
            last = u / 1e6
            out.extend((key[0], *r) for r in lim.offer(last, e))
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        at, ids, arrived = ([w[i] for w in lim.waiting] for i in range(3))
        state.update((list(lim.admitted), list(at), list(ids), list(arrived), last))
        # wake at the next poll of a waiting request, else when the domain's window is surely empty
        wake = min(at) if lim.waiting else last + window_s + MAX_WAIT_S
        state.setTimeoutTimestamp(max(int(wake * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    return (
        _micros(requests.select("domain", "event_id", "ts").withWatermark("ts", watermark))
        .groupBy("domain")
        .applyInPandasWithState(
            update, "domain string, event_id bigint, admitted_at double, waited_s double, warned boolean",
            "admitted array<double>, at array<double>, ids array<bigint>, arrived array<double>, last double", APPEND, GroupStateTimeout.EventTimeTimeout,
        )
    )


def progress(updates: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Smoothed speed and ETA per update (``job_id, event_id, ts, t, size, total``), with ``t`` in seconds."""
    columns = ["job_id", "event_id", "downloaded", "speed", "eta"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from timedframe.functions.progress import Progress

        if state.hasTimedOut:
            state.remove()
            return
        held, done, us = None, 0.0, 0
        if state.exists:
            started, last, times, sizes, speed, eta, rate, done, us = state.get
            held = Progress(started)
            held.last, held.samples, held.speed, held.eta, held.rate = last, deque(zip(times, sizes)), speed, eta, rate
        out = []
        for u, e, t, size, total in _ordered(batches, ["us", "event_id"])[["us", "event_id", "t", "size", "total"]].itertuples(index=False):
            held = held or Progress(t)
            us, done = int(u), done + size
            speed, eta = held.feed(t, done, None if pd.isna(total) else total)
            out.append((key[0], int(e), done, speed, eta))
        times, sizes = [s[0] for s in held.samples], [s[1] for s in held.samples]
        state.update((held.started, held.last, times, sizes, held.speed, held.eta, held.rate, done, us))
        state.setTimeoutTimestamp(max(us // 1000 + STATE_TTL_S * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    return (
        _micros(updates.withWatermark("ts", watermark))
        .groupBy("job_id")
        .applyInPandasWithState(
            update, "job_id bigint, event_id bigint, downloaded double, speed double, eta double",
            "started double, last double, times array<double>, sizes array<double>, speed double, eta double, rate double, done double, us bigint",
            APPEND, GroupStateTimeout.EventTimeTimeout,
        )
    )


def chat_offsets(actions: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Offset per chat action (``media_id, seq, ts, offset_ms``); actions without one carry the last."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, us = state.get if state.exists else (0, 0)
        pdf = _ordered(batches, ["seq"])
        filled = pdf["offset_ms"].ffill().fillna(last).astype("int64")
        last, us = int(filled.iloc[-1]), max(us, int(pdf["us"].max()))
        state.update((last, us))
        state.setTimeoutTimestamp(max(us // 1000 + STATE_TTL_S * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"media_id": key[0], "seq": pdf["seq"].to_numpy(), "offset_ms": filled.to_numpy()})

    return (
        _micros(actions.select("media_id", "seq", "ts", "offset_ms").withWatermark("ts", watermark))
        .groupBy("media_id")
        .applyInPandasWithState(update, "media_id bigint, seq bigint, offset_ms bigint", "last bigint, us bigint", APPEND, GroupStateTimeout.EventTimeTimeout)
    )


def dedup_cues(cues: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Cues (``media_id, id, start, end, text, settings, ts``) without repeats, touching ones joined.

    State per (media, text, settings) is the open cue and the cues it is made of; it is emitted when a cue
    that does not touch it arrives or the watermark passes its end.
    """
    # As a string, because a frame makes numbers with a null floating.
    rows = _micros(cues.select(F.col("media_id").cast("string").alias("media_id"), "id", "start", "end", "text", "settings", "ts").withWatermark("ts", watermark))
    out = rows.groupBy("media_id", "text", "settings").transformWithStateInPandas(OpenCue(), OpenCue.OUTPUT, "Append", "EventTime")
    return out.withColumn("media_id", F.col("media_id").cast("bigint"))
