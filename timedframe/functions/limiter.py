"""Sequential state of the request limiter, shared by the batch replay and the stream."""

from __future__ import annotations

import heapq
import math
from collections import deque


class Limiter:
    """Requests of one domain, offered in time order; waiting ones poll on their own clocks.

    While the window is full, nothing is admitted before its oldest admission leaves it.  So a waiting request goes on to its first poll
    that can have another outcome, and the work per request does not grow with the number of its polls.
    """

    def __init__(self, max_requests: int, window_s: float, poll_s: float, max_wait_s: float):
        self.limit, self.window, self.poll, self.max_wait = max_requests, window_s, poll_s, max_wait_s
        self.admitted: deque[float] = deque()
        self.waiting: list[tuple[float, int, float]] = []

    def _try(self, now: float, event_id: int, arrived: float):
        while self.admitted and self.admitted[0] <= now - self.window:
            self.admitted.popleft()
        if len(self.admitted) < self.limit:
            self.admitted.append(now)
            return event_id, now, now - arrived, False
        if now >= arrived + self.max_wait:
            return event_id, now, now - arrived, True  # goes ahead unrecorded, with a warning
        heapq.heappush(self.waiting, (self._next_poll(now + self.poll, arrived), event_id, arrived))
        return None

    def _next_poll(self, at: float, arrived: float) -> float:
        """The first poll from ``at`` on that does not fail for certain: later admissions only fill the window further."""
        if self.poll <= 0 or not self.admitted:
            return at
        due = arrived + self.max_wait
        steps = max(0, int((min(due, self.admitted[0] + self.window) - at) / self.poll))
        far = at + steps * self.poll
        fine = math.ulp(far)
        if at % fine or self.poll % fine:  # rounds on the way, as poll after poll does
            far = at
            for _ in range(steps):
                far += self.poll
        while self.admitted[0] > far - self.window and far < due:
            far += self.poll
        return far

    def advance(self, now: float):
        """Polls that fall before ``now``."""
        while self.waiting and self.waiting[0][0] < now:
            at, event_id, arrived = heapq.heappop(self.waiting)
            done = self._try(at, event_id, arrived)
            if done:
                yield done

    def offer(self, now: float, event_id: int) -> list:
        out = list(self.advance(now)) if self.waiting and self.waiting[0][0] < now else []
        done = self._try(now, event_id, now)
        return [*out, done] if done else out

    def finish(self) -> list:
        return list(self.advance(float("inf")))
