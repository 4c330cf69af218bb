"""What keeps a service running: repeated calls of a language model, latency counters, and the cycle of sweeps and dreams."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from contextlib import contextmanager
from threading import Lock

# What an error says that may pass by itself.
PASSING_ERRORS = (
    "429", "resource_exhausted", "rate limit", "quota", "timeout", "temporarily unavailable", "connection", " 500", " 502", " 503", " 504",
)
SWEEP_SECONDS, DREAM_SECONDS, BACKOFF_SECONDS = 15 * 60, 24 * 3600, 30 * 60


def passes(error: Exception) -> bool:
    return any(m in str(error).lower() for m in PASSING_ERRORS)


def retried(call: Callable, attempts: int = 3, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """call(), again after a passing error with twice the wait each time; other errors and the last one are raised."""
    for left in reversed(range(max(attempts, 1))):
        try:
            return call()
        except Exception as error:
            if not left or not passes(error):
                raise
        sleep(wait)
        wait *= 2


class Latencies:
    """Count, mean and greatest microseconds of each operation."""

    def __init__(self, clock: Callable[[], int] = time.perf_counter_ns):
        self.clock, self._lock = clock, Lock()
        self._seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

    def record(self, op: str, nanos: int) -> None:
        with self._lock:
            s = self._seen[op]
            s[:] = s[0] + 1, s[1] + nanos, max(s[2], nanos)

    @contextmanager
    def timed(self, op: str):
        began = self.clock()
        try:
            yield
        finally:
            self.record(op, self.clock() - began)

    def stats(self) -> dict[str, dict[str, float]]:
        with self._lock:
            return {op: {"count": n, "avg_us": round(total / n / 1000, 3), "max_us": round(most / 1000, 3)} for op, (n, total, most) in sorted(self._seen.items())}


class Cycle:
    """Sweeps at an interval and dreams at a longer one. A sweep that raises or reports failures is followed by the backoff.

    sweep() gives the number of sessions that failed; dream() is called when it is due, first at once. What a dream raises
    is kept in `errors` and doesn't stop the cycle.
    """

    def __init__(self, sweep: Callable[[], int], dream: Callable[[], object], clock: Callable[[], float] = time.time, sweep_every: float = SWEEP_SECONDS, dream_every: float = DREAM_SECONDS, backoff: float = BACKOFF_SECONDS):
        self.sweep, self.dream, self.clock = sweep, dream, clock
        self.sweep_every, self.dream_every, self.backoff = sweep_every, dream_every, backoff
        self.next_dream = clock()
        self.errors: list[Exception] = []

    def step(self) -> float:
        """One round; seconds until the next."""
        try:
            wait = self.backoff if self.sweep() else self.sweep_every
        except Exception as error:
            self.errors.append(error)
            wait = self.backoff
        now = self.clock()
        if now >= self.next_dream:
            try:
                self.dream()
            except Exception as error:
                self.errors.append(error)
            self.next_dream = now + self.dream_every
        return wait

    def run(self, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
        while rounds is None or rounds > 0:
            sleep(self.step())
            rounds = None if rounds is None else rounds - 1
