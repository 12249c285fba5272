"""Calls to outside services from the driver or from a partition: rate limits, a circuit breaker, retries, batches with a cache."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RateLimiter:
    """At most `rpm` calls in a fixed window of 60 seconds for each key, with counts of requests and of time waited."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep, self.lock = clock, sleep, threading.Lock()
        self.windows: dict[str, tuple[float, int]] = {}
        self.stats: dict[str, dict[str, float]] = {}

    def wait(self, key: str, rpm: float) -> float:
        """Seconds waited for a slot; 0 where there is no limit."""
        if not 0 < rpm < float("inf"):
            return 0.0
        waited = 0.0
        while True:
            with self.lock:
                now = self.clock()
                start, used = self.windows.get(key, (now, 0))
                stats = self.stats.setdefault(key, {"requests": 0, "waited": 0.0})
                if now - start >= 60:
                    start, used = now, 0
                if used < rpm:
                    self.windows[key] = (start, used + 1)
                    stats["requests"] += 1
                    return waited
                rest = max(0.0, 60 - (now - start))
                stats["waited"] += rest
            self.sleep(rest)
            waited += rest


class CircuitOpenError(RuntimeError):
    def __init__(self, remaining: float):
        super().__init__(f"circuit is open for another {remaining:.1f} s")
        self.remaining = remaining


@dataclass
class CircuitBreaker:
    """Opens after `threshold` failures in a row; after `reset` seconds lets `probes` calls through, of which `needed` must
    succeed for it to close, and one failure opens it again."""

    threshold: int = 5
    reset: float = 30.0
    probes: int = 3
    needed: int = 1
    clock: Callable[[], float] = time.monotonic
    state: str = "closed"
    failures: int = 0
    successes: int = 0
    tried: int = 0
    failed_at: float | None = field(default=None)

    def _look(self) -> None:
        if self.state == "open" and self.failed_at is not None and self.clock() - self.failed_at >= self.reset:
            self.state, self.failures, self.successes, self.tried = "half-open", 0, 0, 0

    def allows(self) -> bool:
        self._look()
        return self.state == "closed" or self.state == "half-open" and self.tried < max(1, self.probes)

    def succeeded(self) -> None:
        if self.state == "closed":
            self.failures, self.failed_at = 0, None
        elif self.state == "half-open":
            self.successes += 1
            if self.successes >= max(1, min(self.needed, self.probes)):
                self.state, self.failures, self.successes, self.tried, self.failed_at = "closed", 0, 0, 0, None

    def failed(self) -> None:
        if self.state == "open":
            return
        self.failed_at = self.clock()
        self.failures += 1
        if self.state == "half-open" or self.failures >= max(1, self.threshold):
            self.state, self.successes, self.tried = "open", 0, 0

    def call(self, f: Callable, *args):
        if not self.allows():
            raise CircuitOpenError(0.0 if self.state == "half-open" else max(0.0, self.reset - (self.clock() - (self.failed_at or 0.0))))
        if self.state == "half-open":
            self.tried += 1
        try:
            out = f(*args)
        except Exception:
            self.failed()
            raise
        self.succeeded()
        return out


def retry_delay(base: float, attempt: int, jitter: float = 0.0) -> float:
    """Doubling with each attempt; jitter in [0, 1) adds up to half of the base."""
    return base * 2 ** max(0, attempt - 1) + jitter * max(0.05, base / 2)


def in_batches(items: list, call: Callable[[list], list], size: int = 20, attempts: int = 3, base: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """call over batches, retried; a batch that still fails is split, and an item that fails alone gives None."""
    out: list = []
    for i in range(0, len(items), size):
        part = items[i : i + size]
        for attempt in range(1, attempts + 1):
            try:
                out += call(part)
                break
            except Exception:  # noqa: BLE001 - whatever the service raises counts as a failed attempt
                if attempt < attempts:
                    sleep(retry_delay(base, attempt))
        else:
            out += [None] if len(part) == 1 else in_batches(part, call, len(part) // 2, attempts, base, sleep)
    return out


def embedded(texts: DataFrame, cache: DataFrame, client: Callable[[], Callable[[list[str]], list[list[float]]]], size: int = 20) -> DataFrame:
    """(key, text) and cache (key, vector) -> (key, vector, fresh) of every distinct key: known ones from the cache, the others by a client
    that each partition makes for itself. Vectors of texts that fail are null. Write the fresh ones beside the cache."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for pdf in parts:
            yield pd.DataFrame({"key": pdf["key"], "vector": in_batches(pdf["text"].tolist(), call, size)})

    distinct = texts.dropDuplicates(["key"])
    known = distinct.select("key").join(cache, "key").select("key", "vector", F.lit(False).alias("fresh"))
    missing = distinct.join(cache.select("key"), "key", "left_anti").select("key", "text")
    return known.unionByName(missing.mapInPandas(run, "key string, vector array<double>").withColumn("fresh", F.lit(True)))
