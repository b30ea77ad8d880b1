"""Streams over several triggers give what their batch twins give."""

import heapq
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from timedframe.operators import jobs as jb
from timedframe.sources import captions as cap
from timedframe.sources import logs
from timedframe.streaming import jobs as sj
from timedframe.functions.limiter import Limiter
from timedframe.streaming.processors import OpenCue, StageMap
from timedframe.streaming.run import Merged, drain, read_stream

EV = "event_id long, ts timestamp, job_id long, status string, stage string, elapsed_s double"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    r = random.Random(8)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(160):
        t0 += timedelta(seconds=r.randint(1, 60))
        rows.append((i, t0, r.choice([1, 1, 2, 3]), r.choice(["pending", "started", "finished", "failed"]), r.choice("abc"), r.random()))
    folder = str(tmp_path_factory.mktemp("events") / "in")
    for part in range(4):  # one file per trigger, in event order
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], EV).coalesce(1).write.mode("append").parquet(folder)
    return folder


def both(spark, folder):
    return spark.read.parquet(folder), read_stream(spark, folder, files_per_trigger=1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def merged(stream, keys, tmp_path, **more):
    return Merged(stream, keys, str(tmp_path / "merged"), **more)


def test_job_state(spark, events, tmp_path):
    batch, stream = both(spark, events)
    want = jb.job_state(batch).select("job_id", "status", F.unix_micros("created_at"), F.unix_micros("updated_at"), "submissions")
    assert rows_of(merged(sj.job_state(stream), ["job_id"], tmp_path).drain()) == rows_of(want)


def flat(df):
    return {r.job_id: ({k: (v.status, v.elapsed_s) for k, v in r.stages.items()}, r.current_stage) for r in df.collect()}


def test_stage_map_survives_a_restart(spark, events, tmp_path):
    """Half of the files, then the others with the same checkpoint: the map with elapsed times is that of the batch twin."""
    batch, _ = both(spark, events)
    folder = str(tmp_path / "in")
    halves = [batch.filter("event_id < 70"), batch.filter("event_id >= 70")]
    for half in halves:
        half.coalesce(1).write.mode("append").parquet(folder)
        table = merged(sj.stage_progress(read_stream(spark, folder, files_per_trigger=1)), ["job_id"], tmp_path).drain()
    assert flat(table) == flat(jb.stage_progress(batch))


def test_old_state_is_dropped_and_late_events_change_nothing(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0, 1, "pending"), (2, t0 + timedelta(days=9), 2, "pending"), (3, t0 + timedelta(days=10), 2, "started"), (4, t0, 1, "failed"), (5, t0 + timedelta(days=11), 1, "finished")]
    folder = str(tmp_path / "in")
    for r in rows:
        spark.createDataFrame([r], "event_id long, ts timestamp, job_id long, status string").coalesce(1).write.mode("append").parquet(folder)
        table = merged(sj.job_state(read_stream(spark, folder)), ["job_id"], tmp_path).drain()
    found = {r.job_id: (r.status, r.submissions) for r in table.collect()}
    # Job 1 was forgotten after 48 hours and its late failure is behind the watermark: it begins anew.
    assert found == {1: ("finished", 0), 2: ("started", 1)}


def test_open_windows_come_out_and_replays_change_nothing(spark, events, tmp_path):
    batch, stream = both(spark, events)
    numbered = lambda df: df.withColumn("tokens", F.col("event_id"))
    table = merged(sj.daily_tokens(numbered(stream)), ["day"], tmp_path, compact=2)
    want = rows_of(jb.daily_tokens(numbered(batch)))
    assert rows_of(table.drain()) == want
    assert table._epochs("whole") and len(table._epochs("changes")) >= 4
    # A batch that is repeated after a failure overwrites what it wrote.
    for epoch in table._epochs("changes")[:3]:
        again = spark.read.parquet(f"{table.base}/changes/{epoch:012d}").drop("epoch").collect()
        table.write(spark.createDataFrame(again, table.stream.schema), epoch)
        assert rows_of(table.read()) == want
    assert rows_of(table.drain()) == want


def test_throughput_with_weeks_and_months(spark, events, tmp_path):
    batch, stream = both(spark, events)
    days = merged(sj.throughput(stream), ["day"], tmp_path).drain()
    assert rows_of(jb.roll_up(days)) == rows_of(jb.throughput(batch))


def test_last_beats(spark, events, tmp_path):
    batch, stream = both(spark, events)
    beats = lambda df: df.select(F.col("job_id").alias("worker"), "ts")
    last = merged(sj.last_beats(beats(stream)), ["worker"], tmp_path).drain()
    now = batch.agg(F.max("ts")).first()[0]
    want = jb.liveness(beats(batch), now.isoformat())
    assert rows_of(sj.alive_at(last, F.lit(now))) == rows_of(want)
    assert {r.alive for r in want.collect()} == {True, False}


def test_rate_limit(spark, events):
    batch, stream = both(spark, events)
    cols = [F.col("job_id").cast("string").alias("domain"), "event_id", "ts"]
    want = jb.rate_limit(batch.select(*cols), 2, 120.0)
    got = drain(sj.rate_limit(stream.select(*cols), 2, 120.0, watermark="0 seconds"), "t")
    key = lambda r: (r.domain, r.event_id, round(r.admitted_at, 3), r.warned)
    seen, full = set(map(key, got.collect())), set(map(key, want.collect()))
    end = max(r.ts.timestamp() for r in batch.select("ts").collect())
    # what the stream has not answered yet still waits when the last event comes
    assert seen <= full and all(at > end - 3 for _, _, at, _ in full - seen)
    assert got.filter("waited_s > 0").count() > 0


def test_progress(spark, events):
    batch, stream = both(spark, events)
    cols = ["job_id", "event_id", "ts", (F.unix_micros("ts") / 3e7).alias("t"), (F.col("elapsed_s") * 10).alias("size"), F.lit(500.0).alias("total")]
    want, got = jb.progress(batch.select(*cols)), drain(sj.progress(stream.select(*cols)), "t")
    tidy = lambda df: {r.event_id: tuple(None if v is None or v != v else round(v, 6) for v in (r.downloaded, r.speed, r.eta)) for r in df.collect()}
    assert tidy(want) == tidy(got)


def test_chat_and_cancels(spark, events):
    batch, stream = both(spark, events)
    acts = lambda df: df.select(F.col("job_id").alias("media_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 5).alias("offset_ms"), F.col("stage").alias("action"))
    want = jb.chat_offsets(acts(batch)).select("media_id", "seq", "offset_ms")
    assert rows_of(drain(sj.chat_offsets(acts(stream)), "t")) == rows_of(want)
    cancels = lambda df: df.filter("event_id % 4 = 0").select("job_id", F.col("event_id").alias("cancel_id"), "ts")
    want = jb.apply_cancels(batch, cancels(batch)).select("job_id", "cancel_id", "state_before", "verdict")
    assert rows_of(drain(sj.apply_cancels(stream, cancels(stream)), "t")) == rows_of(want)


def test_dedup_cues(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("", s, s + 10, x) for s, x in [(0, "a"), (10, "a"), (10, "a"), (30, "a"), (40, "b"), (40, "a"), (60, "b"), (50, "a")]]
    data = [(1, i, s, e, x, "", t0 + timedelta(seconds=e)) for i, s, e, x in rows]
    cues = spark.createDataFrame(data, "media_id long, id string, start long, end long, text string, settings string, ts timestamp")
    folder = str(tmp_path / "cues")
    cues.coalesce(1).write.parquet(folder)
    # an event far ahead moves the watermark past every cue
    far = [(9, "", 10**6, 10**6 + 1, "z", "", t0 + timedelta(days=30)), (9, "", 2 * 10**6, 2 * 10**6 + 1, "z", "", t0 + timedelta(days=60))]
    for f in far:
        spark.createDataFrame([f], cues.schema).coalesce(1).write.mode("append").parquet(folder)
    got = drain(sj.dedup_cues(read_stream(spark, folder, files_per_trigger=1)), "t").filter("media_id = 1").select("text", "start", "end")
    want = cap.dedup_cues(cues.drop("ts")).select("text", "start", "end")
    assert rows_of(got) == rows_of(want) == [("a", 0, 20), ("a", 30, 60), ("b", 40, 50), ("b", 60, 70)]


def test_liveness(spark, events):
    batch, stream = both(spark, events)
    got = drain(sj.liveness(stream.select(F.col("job_id").alias("worker"), "ts"), watermark="0 seconds"), "t").collect()
    assert {r.worker for r in got if r.alive} == {1, 2, 3}
    assert any(not r.alive for r in got)  # quiet stretches are longer than the limit


def test_event_log_roundtrip(spark, events, tmp_path):
    batch, stream = both(spark, events)
    cols = ["ts", F.col("status").alias("event"), F.col("job_id").cast("string").alias("job_id"), F.lit(None).cast("string").alias("payload")]
    path = str(tmp_path / "log")
    logs.write_events(batch.select(*cols), path, "svc")
    logs.write_events(batch.select(*cols), path, "svc")
    assert logs.read_events(spark, path, "2024-01-01").count() == 320
    # a streaming writer keeps its own folder, since its commit log decides what readers see there
    own = str(tmp_path / "streamed")
    logs.write_events(stream.select(*cols), own, "svc", str(tmp_path / "state")).awaitTermination()
    assert logs.read_events(spark, own, "2024-01-01").count() == 160
    assert logs.read_events(spark, path, "2024-01-03").count() == 0
    plan = logs.read_events(spark, path, "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_rate_limit_gives_out_rows_as_it_goes(spark, tmp_path, monkeypatch):
    """Rows of one trigger in any order leave in small frames, and the result is that of the batch twin."""
    monkeypatch.setattr(sj, "OUT_ROWS", 7)
    r = random.Random(2)
    rows = [("d", i, datetime(2024, 1, 1) + timedelta(seconds=r.randint(0, 3000))) for i in range(150)]
    folder = str(tmp_path / "requests")
    spark.createDataFrame(rows, "domain string, event_id long, ts timestamp").repartition(3).write.parquet(folder)
    batch, stream = spark.read.parquet(folder), read_stream(spark, folder)
    got = {(x[0], x[1]): x for x in rows_of(drain(sj.rate_limit(stream, 5, 600.0), "limit"))}
    want = {(x[0], x[1]): x for x in rows_of(jb.rate_limit(batch, 5, 600.0))}
    assert got and all(want[k] == x for k, x in got.items())
    pairs = list(sj._sorted_pairs([pd.DataFrame({"us": [5, 3], "event_id": [1, 9]}), pd.DataFrame({"us": [3], "event_id": [2]})], "us", "event_id", 2))
    assert pairs == [(3, 2), (3, 9), (5, 1)]


def test_stage_map_asks_the_state_once_per_trigger():
    """The calls to the state do not grow with the rows of a job."""
    calls = []

    class State:
        def __init__(self):
            self.held = {}

        def get(self):
            calls.append("get")

        def update(self, value):
            calls.append("update")

        def iterator(self):
            calls.append("iterator")
            return iter(self.held.items())

        def containsKey(self, key):
            calls.append("containsKey")
            return key in self.held

        def getValue(self, key):
            calls.append("getValue")
            return self.held[key]

        def updateValue(self, key, value):
            calls.append("updateValue")
            self.held[key] = value

    p = StageMap()
    p.stages, p.current, p.touch = State(), State(), lambda us, timers: None
    rows = [Row(us=i, event_id=i, stage="ab"[i % 2], status=f"s{i}", elapsed_s=1.0 * i) for i in range(100)]
    random.Random(1).shuffle(rows)
    (out,) = p.handleInputRows((1,), iter(rows), None)
    assert {k: v.status for k, v in out.stages.items()} == {"a": "s98", "b": "s99"} and out.current_stage == "b"
    assert len(calls) <= 6


def polled_one_by_one(offers, limit, window, poll, longest):
    """The limiter as it is described: every waiting request polls every ``poll`` seconds."""
    admitted, waiting, out = [], [], []

    def attempt(now, event, arrived):
        if sum(x > now - window for x in admitted) < limit:
            admitted.append(now)
            out.append((event, now, now - arrived, False))
        elif now >= arrived + longest:
            out.append((event, now, now - arrived, True))
        else:
            heapq.heappush(waiting, (now + poll, event, arrived))

    for t, event in [*offers, (float("inf"), None)]:
        while waiting and waiting[0][0] < t:
            attempt(*heapq.heappop(waiting))
        if event is not None:
            attempt(t, event, t)
    return out


def test_limiter_attempts_do_not_grow_with_the_polls(monkeypatch):
    r, attempts = random.Random(5), []
    one = Limiter._try
    monkeypatch.setattr(Limiter, "_try", lambda self, *a: attempts.append(1) or one(self, *a))
    for base, scale in ((1704067200.0, 1.0), (0.0, 1.0), (0.0, 1e-3)):
        offers = [(t, i) for i, t in enumerate(sorted(base + round(r.random() * 3000, 3) * scale for _ in range(600)))]
        limiter, got = Limiter(5, 600.0, 2.0, 300.0), []
        attempts.clear()
        for t, event in offers:
            got += limiter.offer(t, event)
        got += limiter.finish()
        assert got == polled_one_by_one(offers, 5, 600.0, 2.0, 300.0)
        assert len(attempts) < 20 * len(offers)  # poll after poll: up to 150 each


class Held:
    """A handle with one value state that counts what would be round trips."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.calls.append("register")
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls.append("delete")
        self.timers.remove(ms)

    def getCurrentWatermarkInMs(self):
        return 0


def test_an_open_cue_costs_three_calls_and_its_timer_gives_it_out():
    held, state = Held(), OpenCue()
    state.init(held)
    n = 20_000
    frame = pd.DataFrame({"start": range(n), "end": range(1, n + 1), "id": "", "us": range(n)})
    assert list(state.handleInputRows((1, "a", ""), iter([frame, frame]), held)) == []
    assert sorted(held.calls) == ["get", "register", "update"]
    assert [f.values.tolist() for f in state.handleExpiredTimer((1, "a", ""), held, None)] == [[[1, "a", "", "", 0, n]]]
    assert held.value is None


def test_dedup_cues_of_a_media_without_id(spark, tmp_path):
    t0, big = datetime(2024, 1, 1), (1 << 53) + 1
    data = [(m, "", s, s + 10, "a", "", t0 + timedelta(seconds=s + 10)) for m in (None, big) for s in (0, 10)]
    data += [(9, "", 10**6, 10**6 + 1, "z", "", t0 + timedelta(days=30))]
    folder = str(tmp_path / "cues")
    spark.createDataFrame(data, "media_id long, id string, start long, end long, text string, settings string, ts timestamp").coalesce(1).write.parquet(folder)
    got = drain(sj.dedup_cues(read_stream(spark, folder)), "t").filter("text = 'a'").select("media_id", "start", "end").collect()
    assert {tuple(r) for r in got} == {(None, 0, 20), (big, 0, 20)}
