"""Tables written between the jobs of one operator.

A staged table lives in the folder that the session names in ``spark.checkpoint.dir``, which every
executor and the driver share, so a lost executor costs a re-read and not a recomputation. Where the
setting is absent, a temporary folder of this process stands in if Spark runs in this process alone (local tests);
on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for staged tables."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="palimpsest-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


class Staging:
    """Named Parquet tables of one operator call, below the shared folder."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame | Callable[[], DataFrame], name: str, moved_much: bool = False) -> DataFrame:
        """Write a table and return it as written, without lineage behind it.

        ``moved_much``: the job moves whole texts or ids, so its shuffle files are to go at once. Nothing else may
        hold its plan then: ``df`` is a function that builds the table.
        """
        df = df() if callable(df) else df
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        del df
        if moved_much:
            self.release()
        return self.read(name, schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished jobs now, not at some later collection.

        The event that ends a job holds its plan until the listeners have seen it.
        """
        context = self.spark.sparkContext
        gc.collect()
        with contextlib.suppress(Py4JJavaError):  # listeners that lag only delay the deletion
            context._jsc.sc().listenerBus().waitUntilEmpty(2_000)
        for _ in range(2):  # what the first round finalizes, the second one collects
            context._jvm.System.gc()
            time.sleep(0.1)


def bound_arrow_batches(spark: SparkSession, rows: int = 2048, size: str = "4m") -> None:
    """Bound what one Arrow batch holds, by rows and by bytes, for this session's Python stages. The settings stay, since
    plans run after the call that makes them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def trimmed(run: Callable) -> Callable:
    """``run`` over Arrow batches that gives freed memory back to the system when its task ends.

    Python workers outlive their tasks, and what Arrow and the allocator keep for reuse counts for the executor.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
