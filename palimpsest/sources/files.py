"""Files at any path that Spark reaches: through its file systems on the driver, by ranges in tasks."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    """(file system, path) of the JVM; the file system is the caller's own and writes no checksum files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(conf).makeQualified(place)
    system = jvm.org.apache.hadoop.fs.FileSystem.newInstance(place.toUri(), conf)
    system.setWriteChecksum(False)
    return system, place


@contextlib.contextmanager
def _system(spark: SparkSession, path: str):
    system, place = _place(spark, path)
    try:
        yield system, place
    finally:
        system.close()


def exists(spark: SparkSession, path: str) -> bool:
    with _system(spark, path) as (system, place):
        return system.exists(place)


def read(spark: SparkSession, path: str, offset: int = 0, size: int | None = None) -> bytes:
    """``size`` bytes from ``offset`` on, or fewer where the file ends; all that follow without a size."""
    with _system(spark, path) as (system, place):
        there = system.getFileStatus(place).getLen() - offset
        size = there if size is None else min(size, there)
        if size <= 0:
            return b""
        stream = system.open(place)
        try:
            stream.seek(offset)
            return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
        finally:
            stream.close()


def delete(spark: SparkSession, path: str) -> None:
    with _system(spark, path) as (system, place):
        system.delete(place, True)


def children(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """(path, name, time of the last change in seconds) of what lies directly in a folder; empty if there is none."""
    with _system(spark, folder) as (system, place):
        if not system.exists(place):
            return []
        return [(s.getPath().toString(), s.getPath().getName(), s.getModificationTime() // 1000) for s in system.listStatus(place)]


def write(spark: SparkSession, path: str, pieces: Iterator[bytes]) -> None:
    """Write a file piece by piece under another name, then put it in its place."""
    jvm = spark.sparkContext._jvm
    with _system(spark, path) as (system, place):
        part = place.suffix(".part")
        stream = system.create(part, True)
        try:
            for piece in pieces:
                for k in range(0, len(piece), 8 << 20):
                    stream.write(bytearray(piece[k : k + (8 << 20)]))
            stream.hsync()
        except BaseException:
            stream.close()
            system.delete(part, False)
            raise
        stream.close()
        replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, place, replace)


def opened(path: str):
    """A file in a task, open for reading by ranges: at a mounted path, or in a store that Arrow knows."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path) if parts.scheme else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def by_ranges(path: str) -> bool:
    """Whether tasks can open the file themselves."""
    if urlsplit(path).scheme in ("", "file"):
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except (ValueError, OSError, NotImplementedError):  # no such store, or its library is not there
        return False
    return True
