"""Stateful processors, which hold a state per key and an event-time timer.

``JobState`` and ``StageMap`` stream a key's rows of a trigger one by one against its state, never held together; their result doesn't
depend on the order of the rows, so nothing is sorted, and the timer drops the state ``STATE_TTL_S`` after the key's last event.
``OpenCue`` sorts the rows of a key in a trigger, and its timer gives out the open cue.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from timedframe.operators.jobs import STATE_TTL_S


class _Expiring(StatefulProcessor):
    """Keeps one timer per key: ``STATE_TTL_S`` after the key's last event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "ms bigint")

    def touch(self, us: int, timers) -> None:
        """Moves the timer; one that the watermark has passed already fires at the next trigger."""
        due = max(us // 1000 + STATE_TTL_S * 1000, timers.getCurrentWatermarkInMs() + 1)
        old = self.expiry.get()
        if old is not None and old[0] != due:
            self.handle.deleteTimer(old[0])
        if old is None or old[0] != due:
            self.handle.registerTimer(due)
            self.expiry.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.expiry.clear()
        self.forget()
        return iter(())

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class JobState(_Expiring):
    """Last status by (time, event id), first and last time, and number of submissions of a job."""

    OUTPUT = "job_id bigint, status string, created_us bigint, updated_us bigint, submissions bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "status string, us bigint, event_id bigint, created bigint, submissions bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, us, event_id, created, submissions = self.held.get() or (None, -(1 << 62), -1, 1 << 62, 0)
        for row in rows:
            if (row.us, row.event_id) > (us, event_id):
                status, us, event_id = row.status, row.us, row.event_id
            created = min(created, row.us)
            submissions += row.status == "pending"
        self.held.update((status, us, event_id, created, submissions))
        self.touch(us, timerValues)
        yield Row(job_id=key[0], status=status, created_us=created, updated_us=us, submissions=submissions)

    def forget(self) -> None:
        self.held.clear()


class StageMap(_Expiring):
    """The stages of a job, each with its last status and elapsed time, and the stage of the last event.

    A stage is an entry of its own in the state.  A trigger reads the entries of a job once and writes those that change,
    however many rows it has: each call to the state is a round trip to the executor.
    """

    ENTRY = "us bigint, event_id bigint, status string, elapsed_s double"
    OUTPUT = "job_id bigint, stages map<string, struct<status: string, elapsed_s: double>>, current_stage string, current_us bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stages = handle.getMapState("stages", "stage string", self.ENTRY)
        self.current = handle.getValueState("current", "us bigint, event_id bigint, stage string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        us, event_id, stage = self.current.get() or (-(1 << 62), -1, None)
        entries = {name[0]: tuple(entry) for name, entry in self.stages.iterator()}
        changed = set()
        for row in rows:
            old = entries.get(row.stage)
            if old is None or (row.us, row.event_id) > (old[0], old[1]):
                entries[row.stage] = (row.us, row.event_id, row.status, row.elapsed_s)
                changed.add(row.stage)
            if (row.us, row.event_id) > (us, event_id):
                us, event_id, stage = row.us, row.event_id, row.stage
        for name in changed:
            self.stages.updateValue((name,), entries[name])
        self.current.update((us, event_id, stage))
        self.touch(us, timerValues)
        stages = {name: Row(status=entry[2], elapsed_s=entry[3]) for name, entry in entries.items()}
        yield Row(job_id=key[0], stages=stages, current_stage=stage, current_us=us)

    def forget(self) -> None:
        self.stages.clear()
        self.current.clear()


class OpenCue(StatefulProcessor):
    """The open cue of a (media, text, settings) and the cues that it is made of; see ``jobs.dedup_cues``.

    All that a key keeps, its timer's time too, is one value: each call to the state is a round trip to the executor.
    """

    OUTPUT = "media_id string, text string, settings string, id string, start bigint, end bigint"
    COLUMNS = ["media_id", "text", "settings", "id", "start", "end"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "first string, start bigint, end bigint, seen array<string>, us bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, start, end, seen, us, old = self.held.get() or (None, None, None, [], 0, None)
        marks, out = set(seen), []
        came = [r for frame in rows for r in zip(*(frame[c].tolist() for c in ("start", "end", "id", "us")))]
        for s, e, i, u in sorted(came, key=itemgetter(0, 1)):
            mark = f"{i}|{s}|{e}"
            us = max(us, u)
            if mark in marks:
                continue
            if start is not None and s == end:
                end = e
                marks.add(mark)
                continue
            if start is not None:
                out.append((*key, first, start, end))
            first, start, end, marks = i, s, e, {mark}
        due = max(us // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        if old != due:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        self.held.update((first, start, end, sorted(marks), us, due))
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, start, end = self.held.get()[:3]
        self.held.clear()
        yield pd.DataFrame([(*key, first, start, end)], columns=self.COLUMNS)

    def close(self) -> None:
        pass
