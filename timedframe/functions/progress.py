"""Sequential state of a transfer's speed and ETA, shared by the batch replay and the stream."""

from __future__ import annotations

from collections import deque

WINDOW_S = 3.0
RATE_S = 0.05
GRACE_S = 1.0
SPEED_KEEP = 0.7
ETA_KEEP = 0.9


class Progress:
    """Feed (time, downloaded so far, total) in order; read ``speed`` and ``eta`` after each feed."""

    def __init__(self, started: float, now: float | None = None):
        self.started = started
        self.last = started if now is None else now - WINDOW_S
        self.samples = deque([(started, 0.0)]) if now is None else deque()
        self.speed, self.eta = 0.0, None
        self.rate = 0.0

    def feed(self, now: float, downloaded: float, total: float | None) -> tuple[float, float | None]:
        if self.last + RATE_S > now:
            return self.speed, self.eta
        self.last = now
        self.samples.append((now, downloaded))
        while self.samples[0][0] < now - WINDOW_S:
            self.samples.popleft()
        if len(self.samples) < 2:
            self.speed, self.eta, self.rate = 0.0, None, 0.0
            return self.speed, self.eta
        first_t, first_d = self.samples[0]
        if now > first_t:
            self.rate = (downloaded - first_d) / (now - first_t)
            self.speed = (1 - SPEED_KEEP) * self.rate + SPEED_KEEP * self.speed
            if total and self.rate and now - self.started > GRACE_S:
                eta = (max(total, downloaded) - downloaded) / self.rate
                self.eta = eta if self.eta is None else (1 - ETA_KEEP) * eta + ETA_KEEP * self.eta
            else:
                self.eta = None
        return self.speed, self.eta
