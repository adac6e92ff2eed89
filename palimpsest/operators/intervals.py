"""Byte layouts and byte-range reads as interval joins."""

from __future__ import annotations

import bisect
import io
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .offsets import number_buckets, running_before


def layout(parts: DataFrame, order_col: str, size_col: str, buckets: int | None = None, origin: int = 0) -> DataFrame:
    """Add ``start`` and ``end``: the parts' places, end to end from ``origin``, in the order of a numeric column."""
    placed = running_before(parts, [F.col(order_col)], F.col(size_col).cast("long"), number_buckets(parts, order_col, buckets), "__start")
    start = F.col("__start") + F.lit(origin)
    return placed.withColumn("start", start.cast("long")).withColumn("end", (start + F.col(size_col)).cast("long")).drop("__start")


def file_size(intervals: DataFrame, header_size: int = 0) -> int:
    """The largest end, or the header's size."""
    return max(header_size, intervals.agg(F.max("end")).first()[0] or 0)


def overlaps(requests: DataFrame, intervals: DataFrame, width: int | None = None) -> DataFrame:
    """Requests (req_id, offset, size) joined to the intervals [start, end) that they overlap, with ``lo`` and ``hi``:
    the overlap's bounds. Negative offsets and sizes under 1 read nothing.

    Both sides are cut into bins of ``width`` bytes (by default the mean interval, and no less than a mean request),
    so the join is an equi-join on the bin; a pair counts in the first bin that both share.
    """
    asked = requests.where("offset >= 0 and size > 0").withColumn("__to", F.col("offset") + F.col("size"))
    whole = intervals.where("end > start")
    if width is None:
        means = [whole.agg(F.avg(F.col("end") - F.col("start"))).first()[0], asked.agg(F.avg("size")).first()[0]]
        width = max(1, int(max(m or 1 for m in means)))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    left = asked.withColumn("__bin", bins("offset", "__to"))
    right = whole.withColumn("__bin2", bins("start", "end"))
    lo, hi = F.greatest("offset", "start"), F.least("__to", "end")
    met = left.join(right, (F.col("__bin") == F.col("__bin2")) & (F.col("offset") < F.col("end")) & (F.col("start") < F.col("__to")) & (F.col("__bin") == F.floor(F.greatest("offset", "start") / width)))
    return met.withColumn("lo", lo).withColumn("hi", hi).drop("__bin", "__bin2", "__to")


def read_ranges(requests: DataFrame, intervals: DataFrame, total: int, header: bytes = b"") -> DataFrame:
    """req_id, data: the bytes of each request (req_id unique) against intervals (start, end, data) of a file of ``total`` bytes.

    The header counts as the interval at 0; gaps are zeros; what lies past the end is cut off.
    """
    spark = requests.sparkSession
    parts = intervals.select("start", "end", F.col("data").cast("binary").alias("data"))
    if header:
        parts = parts.unionAll(spark.createDataFrame([(0, len(header), bytearray(header))], parts.schema))
    met = overlaps(requests.select("req_id", "offset", "size"), parts)
    piece = F.struct("lo", F.substring("data", F.col("lo") - F.col("start") + 1, F.col("hi") - F.col("lo")).alias("bytes"))
    pieces = met.groupBy("req_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    joined = requests.select("req_id", "offset", "size").join(pieces, "req_id", "left")

    def fill(frames):
        for frame in frames:
            out = []
            for offset, size, pieces in zip(frame["offset"], frame["size"], frame["pieces"], strict=True):
                end = min(int(offset) + int(size), total)
                if offset < 0 or size <= 0 or offset >= end:
                    out.append(b"")
                    continue
                buffer = bytearray(end - int(offset))
                for lo, data in ((p["lo"], p["bytes"]) for p in (pieces if pieces is not None else ())):
                    buffer[lo - int(offset) : lo - int(offset) + len(data)] = data
                out.append(bytes(buffer[: end - int(offset)]))
            yield frame[["req_id"]].assign(data=out)

    return joined.mapInPandas(fill, "req_id long, data binary")


def ranged(places: list[tuple[int, int, str | None]], head: bytes, fetch: Callable[[str], bytes]) -> Callable[[int, int], bytes]:
    """A function (offset, size) -> bytes over places (start, end, name; the header's without a name), which come in order and
    don't overlap. ``fetch`` gives a name's bytes; gaps are zeros."""
    ends = [end for _, end, _ in places]

    def read_at(offset: int, size: int) -> bytes:
        stop = min(offset + size, ends[-1])
        out = bytearray(max(0, stop - offset))
        for start, end, name in places[bisect.bisect_right(ends, offset) :]:
            if start >= stop:
                break
            lo, hi = max(start, offset), min(end, stop)
            if lo < hi:
                out[lo - offset : hi - offset] = (head if name is None else fetch(name))[lo - start : hi - start]
        return bytes(out)

    return read_at


class VirtualFile(io.RawIOBase):
    """A seekable read-only file over a function (offset, size) -> bytes."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self._read_at, self._size, self._at = read_at, size, 0

    def readable(self) -> bool:
        return not self.closed

    def seekable(self) -> bool:
        return not self.closed

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        base = {os.SEEK_SET: 0, os.SEEK_CUR: self._at, os.SEEK_END: self._size}
        if whence not in base:
            raise ValueError(f"unknown whence {whence}")
        self._at = max(0, base[whence] + offset)
        return self._at

    def readinto(self, buffer) -> int:
        data = self._read_at(self._at, len(buffer)) if self._at < self._size and len(buffer) else b""
        buffer[: len(data)] = data
        self._at += len(data)
        return len(data)
