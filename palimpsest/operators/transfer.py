"""Set differences between stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import content_hash


def missing(required: DataFrame, existing: DataFrame) -> DataFrame:
    """The distinct hashes of ``required`` that ``existing`` lacks."""
    return required.select("hash").distinct().join(existing.select("hash"), "hash", "left_anti")


def transfer(wanted: DataFrame, source: DataFrame) -> DataFrame:
    """hash, data of the wanted objects of a source, each once; one without an intact copy raises an error."""
    found = source.join(wanted.select("hash").distinct(), "hash", "left_semi").select("hash", "data")
    intact = F.coalesce(content_hash(F.col("data")) == F.col("hash"), F.lit(False))
    once = found.withColumn("intact", intact).groupBy("hash").agg(F.max_by("data", "intact").alias("data"), F.max("intact").alias("intact"))
    return once.select("hash", F.when(F.col("intact"), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("altered object "), F.col("hash"))).cast("binary")).alias("data"))
