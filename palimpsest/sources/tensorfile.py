"""Checkpoint files: 8 bytes of header length, a JSON header, tensor bytes.

``read_tensors`` gives a row per tensor of files at any path that Spark reaches. Where tasks can open the files
themselves, headers are read first and each tensor by its byte range alone, so a file may have any size; of other stores
whole files pass through Spark's binary reader, which takes up to 2 GB. One tensor is one cell, of up to 2 GB.
``TensorFileSource`` is a data source for mounted paths: a partition per tensor, with filters on ``name``
pushed down.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from . import files

SCHEMA = "model string, name string, dtype string, shape array<bigint>, start bigint, end bigint, data binary"
METADATA = "__metadata__"


def parse_header(raw: bytes) -> tuple[int, dict]:
    """(where the tensors' bytes start, the header). ``raw`` may be longer than the header."""
    if not isinstance(raw, (bytes, bytearray, memoryview)):
        raise TypeError("bytes are needed")
    if len(raw) < 8:
        raise ValueError("a file of less than 8 bytes has no header")
    size = struct.unpack("<Q", bytes(raw[:8]))[0]
    if len(raw) < 8 + size:
        raise ValueError("the file ends within its header")
    return 8 + size, json.loads(bytes(raw[8 : 8 + size]))


def _header_from(read) -> bytes:
    """A file's first bytes up to its tensors, by ``read`` (offset, size)."""
    first = read(0, 8)
    if len(first) < 8:
        raise ValueError("a file of less than 8 bytes has no header")
    return first + read(8, struct.unpack("<Q", first)[0])


def read_header(path: str) -> tuple[int, dict]:
    """Reads the header alone, of a file at a mounted path."""
    with open(path, "rb") as file:
        return parse_header(_header_from(lambda offset, size: file.read(size)))


def header_of(spark: SparkSession, path: str) -> bytes:
    """The bytes before the tensors of a file at any path that Spark reaches."""
    raw = _header_from(lambda offset, size: files.read(spark, path, offset, size))
    parse_header(raw)
    return raw


def tensor_entries(header: dict) -> dict[str, dict]:
    return {name: entry for name, entry in header.items() if name != METADATA and isinstance(entry, dict)}


def header_bytes(entries: Iterable[tuple[str, str, list[int], int]], metadata: dict | None = None) -> tuple[bytes, dict[str, tuple[int, int]]]:
    """Header of tensors (name, dtype, shape, bytes), by name, end to end; and each one's range."""
    header, at, ranges = ({METADATA: metadata} if metadata else {}), 0, {}
    for name, dtype, shape, size in sorted(entries):
        header[name] = {"dtype": dtype, "shape": [int(n) for n in shape], "data_offsets": [at, at + size]}
        ranges[name], at = (at, at + size), at + size
    text = json.dumps(header, separators=(",", ":")).encode()
    return struct.pack("<Q", len(text)) + text, ranges


def serialize(tensors: dict[str, tuple[str, list[int], bytes]], metadata: dict | None = None) -> bytes:
    head, _ = header_bytes(((n, d, s, len(b)) for n, (d, s, b) in tensors.items()), metadata)
    return head + b"".join(tensors[n][2] for n in sorted(tensors))


def load_tensor(path: str, name: str) -> tuple[str, list[int], bytes]:
    """(dtype, shape, bytes) of one tensor by a single range read; KeyError if there is none of that name."""
    start, header = read_header(path)
    entry = tensor_entries(header)[name]
    a, b = entry["data_offsets"]
    with open(path, "rb") as file:
        file.seek(start + a)
        return entry["dtype"], entry["shape"], file.read(b - a)


_KINDS = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
MOST_BYTES = (1 << 31) - 1


def _row(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS, strict=True)], names=_NAMES)


def _whole(batches):
    """Tensors of files that came whole (path, content)."""
    for batch in batches:
        for model, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = memoryview(raw.as_buffer())
            at, header = parse_header(held)
            for name, e in tensor_entries(header).items():
                a, b = e["data_offsets"]
                yield _row((model, name, e["dtype"], e["shape"], a, b, bytes(held[at + a : at + b])))


def _headers(batches):
    """(model, at, name, dtype, shape, start, end) of the tensors of files (path)."""
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            with files.opened(path) as file:
                at, header = parse_header(_header_from(lambda offset, size: file.read(size)))  # noqa: B023
            for name, e in tensor_entries(header).items():
                a, b = e["data_offsets"]
                if b - a > MOST_BYTES:
                    raise ValueError(f"tensor {name} of {path} has over 2 GB")
                rows.append((path, at, name, e["dtype"], e["shape"], a, b))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["model", "at", "name", "dtype", "shape", "start", "end"])


def _ranged(batches):
    """Tensors by their byte ranges."""
    for batch in batches:
        for model, at, name, dtype, shape, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with files.opened(model) as file:
                file.seek(at + a)
                data = file.read(b - a)
            if len(data) != b - a:
                raise ValueError(f"tensor {name} of {model} is cut off")
            yield _row((model, name, dtype, shape, a, b, data))


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """All tensors of the files at ``path``; the model is the file's path."""
    found = spark.read.format("binaryFile").load(path)
    one = found.select("path").first()
    if one is not None and not files.by_ranges(one[0]):
        return found.select("path", "content").mapInArrow(_whole, SCHEMA)
    placed = found.select("path").mapInArrow(_headers, "model string, at long, name string, dtype string, shape array<bigint>, start long, end long")
    # tensors of one file are read by many tasks
    return placed.repartition("model", "name").mapInArrow(_ranged, SCHEMA)


def write_tensors(tensors: DataFrame, path: str, metadata: dict | None = None) -> None:
    """One model's tensors to a file at any path that Spark reaches: the header from their sizes, then a tensor at a
    time, in order of name, through the driver."""
    sizes = [tuple(r) for r in tensors.select("name", "dtype", "shape", F.octet_length("data")).collect()]  # no data
    if len({s[0] for s in sizes}) != len(sizes):
        raise ValueError("tensor names repeat")
    head, _ = header_bytes(sizes, metadata)

    def pieces():
        yield head
        for row in tensors.orderBy("name").select("data").toLocalIterator():
            yield bytes(row[0])

    files.write(tensors.sparkSession, path, pieces())


class _Part(InputPartition):
    def __init__(self, path: str, name: str, at: int, entry: dict):
        self.path, self.name, self.at, self.entry = path, name, at, entry


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths, self.names = paths, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self._keep({f.value})
            elif isinstance(f, In) and f.attribute == ("name",):
                self._keep(set(f.value))
            else:
                yield f

    def _keep(self, names: set) -> None:
        self.names = names if self.names is None else self.names & names

    def partitions(self):
        out = []
        for path in self.paths:
            at, header = read_header(path)
            out += [_Part(path, n, at, e) for n, e in tensor_entries(header).items() if self.names is None or n in self.names]
        return out or [_Part("", "", 0, {})]

    def read(self, part) -> Iterator[tuple]:
        if not part.path:
            return
        a, b = part.entry["data_offsets"]
        with open(part.path, "rb") as file:
            file.seek(part.at + a)
            yield part.path, part.name, part.entry["dtype"], part.entry["shape"], a, b, file.read(b - a)


class TensorFileSource(DataSource):
    """``spark.read.format("tensorfile").load(path)``; several paths are parted by commas."""

    @classmethod
    def name(cls) -> str:
        return "tensorfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options["path"].split(",") if p])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorFileSource)
