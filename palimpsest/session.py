"""Session settings that the operators assume."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",  # the tensor file source prunes by name
}


def build_session(master: str | None = None, app: str = "palimpsest", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``; one of this process's own only
    where Spark runs in this process alone."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="palimpsest-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def new_folder(spark: SparkSession, what: str) -> str:
    """A new name below the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
