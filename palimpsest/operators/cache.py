"""Least-recently-used admission by a budget of bytes."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .offsets import running_before


def last_accesses(log: DataFrame, item: str, at: str, size: str) -> DataFrame:
    """item, last, size: each item's last access and the size it then had."""
    return log.groupBy(item).agg(F.max(at).alias("last"), F.max_by(size, F.struct(at, size)).alias("size"))


def resident(accesses: DataFrame, capacity: int, bucket: Column, item: str = "item", order: list[Column] | None = None) -> DataFrame:
    """Add ``newer`` (bytes of items used later) and ``is_resident``: the most recent items whose sum stays within
    ``capacity``; the most recent one stays whatever its size. ``bucket`` must not decrease along the order."""
    order = order or [F.col("last").desc(), F.col(item)]
    placed = running_before(accesses, order, F.col("size"), bucket, "newer")
    return placed.withColumn("is_resident", (F.col("newer") + F.col("size") <= capacity) | (F.col("newer") == 0))


def cache_stats(items: DataFrame, capacity: int) -> DataFrame:
    """n_items, bytes, capacity, utilization_pct of resident items."""
    total = F.coalesce(F.sum("size"), F.lit(0))
    return items.where("is_resident").agg(F.count(F.lit(1)).alias("n_items"), total.alias("bytes"), F.lit(capacity).alias("capacity"), (100.0 * total / capacity).alias("utilization_pct"))


class RecentBytes:
    """Values made by ``make`` and kept by recency within ``capacity`` bytes; safe to share between threads.

    Values are made outside the lock: two threads may make one at once, and the first one stays. The latest value stays
    whatever its size.
    """

    def __init__(self, capacity: int, make: Callable[[str], bytes]):
        self.capacity, self.make = capacity, make
        self.lock, self.held, self.size = threading.Lock(), OrderedDict(), 0

    def get(self, key: str) -> bytes:
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
                return self.held[key]
        value = self.make(key)
        with self.lock:
            if key not in self.held:
                while self.held and self.size + len(value) > self.capacity:
                    self.size -= len(self.held.popitem(last=False)[1])
                self.held[key] = value
                self.size += len(value)
            return self.held[key]

    def stats(self) -> dict:
        with self.lock:
            return {"n_items": len(self.held), "bytes": self.size, "capacity": self.capacity, "utilization_pct": 100.0 * self.size / self.capacity}

    def clear(self) -> None:
        with self.lock:
            self.held.clear()
            self.size = 0
