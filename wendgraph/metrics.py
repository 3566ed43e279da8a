"""Driver-side counters of an engine."""

from __future__ import annotations

import time
from collections import deque


class Metrics:
    """Times a query took for each of its rows, and node reads by whether the view was kept in memory."""

    def __init__(self) -> None:
        self._begun, self._hops = time.time(), deque(maxlen=10_000)
        self._hits = self._misses = self.serialization_time_us = 0
        self._in_memory = False

    def hop(self, us: float) -> None:
        self._hops.append(us)

    def cached(self, now: bool = True) -> None:
        self._in_memory = now

    def read(self) -> None:
        self._hits += self._in_memory
        self._misses += not self._in_memory

    def hit_ratio(self) -> float:
        return self._hits / (self._hits + self._misses) if self._hits + self._misses else 0.0

    def report(self) -> dict:
        ordered = sorted(self._hops)
        p99 = ordered[min(len(ordered) - 1, int(0.99 * len(ordered)))] if ordered else 0.0
        return {"hop_latency_us": self._hops[-1] if self._hops else 0.0, "serialization_time_us": self.serialization_time_us, "cache_hits": self._hits, "cache_misses": self._misses, "hit_ratio": self.hit_ratio(), "traversal_p99_us": p99, "uptime": time.time() - self._begun}
