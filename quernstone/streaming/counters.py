"""Requests and errors of the last minute, hour and day: running totals, one entry for each second that saw a request, none older than a day."""

from __future__ import annotations

import bisect
import threading
import time
from collections import deque

SPANS = {"last_1m": 60, "last_1h": 3_600, "last_24h": 86_400}


class Counters:
    """Each entry holds a second and the totals up to its end, so a span is the difference of two totals."""

    def __init__(self, clock=time.time):
        self.clock, self.started, self.lock = clock, clock(), threading.Lock()
        self.entries: deque[tuple[int, int, int]] = deque()
        self.forgotten = (0, 0)  # the totals of the newest entry that was let go

    def _totals(self) -> tuple[int, int]:
        return self.entries[-1][1:] if self.entries else self.forgotten

    def _forget(self, now: int) -> None:
        while self.entries and now - self.entries[0][0] >= SPANS["last_24h"]:
            self.forgotten = self.entries.popleft()[1:]

    def record(self, error: bool) -> None:
        with self.lock:
            now = max(int(self.clock()), self.entries[-1][0] if self.entries else 0)  # a clock that is set back makes no new entry
            queries, errors = self._totals()
            if self.entries and self.entries[-1][0] == now:
                self.entries.pop()
            self.entries.append((now, queries + 1, errors + bool(error)))
            self._forget(now)

    def snapshot(self) -> dict:
        now = int(self.clock())
        out = {"uptime_secs": max(0, int(self.clock() - self.started)), "queries": {}, "errors": {}}
        with self.lock:
            self._forget(now)
            entries, (queries, errors) = list(self.entries), self._totals()
            forgotten = self.forgotten
        for name, span in SPANS.items():
            older = bisect.bisect_right(entries, (now - span, float("inf")))
            before = entries[older - 1][1:] if older else forgotten
            out["queries"][name], out["errors"][name] = queries - before[0], errors - before[1]
        return out
