"""Clocks and schedulers: real ones, and virtual ones for tests that must not wait."""

from __future__ import annotations

import heapq
import itertools
import threading
import time
from collections.abc import Callable


class SystemClock:
    def now_ms(self) -> int:
        return time.time_ns() // 1_000_000


class ThreadScheduler:
    """Timers on threads of this process. Both methods return a function that cancels."""

    def once(self, at_ms: int, task: Callable[[], None]) -> Callable[[], None]:
        timer = threading.Timer(max(0, at_ms - SystemClock().now_ms()) / 1000, task)
        timer.daemon = True
        timer.start()
        return timer.cancel

    def every(self, period_ms: int, task: Callable[[], None]) -> Callable[[], None]:
        stop = threading.Event()

        def run():
            while not stop.wait(period_ms / 1000):
                task()

        threading.Thread(target=run, daemon=True).start()
        return stop.set


class VirtualTime:
    """A clock that moves when told, and the timers due on the way, in order of (due time, creation)."""

    def __init__(self, start_ms: int = 0):
        self._now, self._ids, self._heap, self._lock = start_ms, itertools.count(), [], threading.RLock()
        self._dead: set[int] = set()

    def now_ms(self) -> int:
        return self._now

    def _add(self, at_ms: int, task, period: int | None, key: int | None = None) -> Callable[[], None]:
        with self._lock:
            key = next(self._ids) if key is None else key
            heapq.heappush(self._heap, (at_ms, key, task, period))
        return lambda: self._dead.add(key)

    def once(self, at_ms: int, task: Callable[[], None]) -> Callable[[], None]:
        return self._add(max(at_ms, self._now), task, None)

    def every(self, period_ms: int, task: Callable[[], None]) -> Callable[[], None]:
        """Re-armed from the time it was due, so a long step fires it as often as it was due."""
        return self._add(self._now + period_ms, task, period_ms)

    def advance(self, ms: int, settle: Callable[[], None] = lambda: None) -> None:
        """Move time by ``ms``, firing what is due; ``settle`` runs after each timer and at the end."""
        end = self._now + ms
        while True:
            with self._lock:
                if not self._heap or self._heap[0][0] > end:
                    break
                at, key, task, period = heapq.heappop(self._heap)
                if key in self._dead:
                    continue
                self._now = max(self._now, at)
                if period:
                    self._add(at + period, task, period, key)
            task()
            settle()
        self._now = end
        settle()


class VirtualHarness:
    """A virtual clock with the worker that it drives: steps of time, then quiet."""

    def __init__(self, start_ms: int = 0):
        self.time = VirtualTime(start_ms)
        self.worker = None

    def flush(self) -> None:
        """Wait until no handler runs or all that do wait for their lease to end."""
        if self.worker is not None:
            self.worker.quiet()

    def advance(self, ms: int) -> None:
        self.flush()
        self.time.advance(ms, self.flush)
