"""Verification of referenced objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import content_hash


def classify(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """hash, type, state (ok, missing, tampered), size for each distinct referenced hash.

    ``refs`` (hash, type, ord): a hash that several refs name takes the type of the least ord. ``objects``
    (hash, data): a hash that stands several times counts once, by its intact copy if it has one.
    """
    once = refs.groupBy("hash").agg(F.min_by("type", "ord").alias("type"))
    stored = objects.select("hash", F.coalesce(content_hash(F.col("data")) == F.col("hash"), F.lit(False)).alias("intact"), F.octet_length("data").cast("long").alias("size"))
    found = stored.groupBy("hash").agg(F.max("intact").alias("intact"), F.max_by("size", "intact").alias("size"))
    state = F.when(F.col("intact").isNull(), "missing").when(F.col("intact"), "ok").otherwise("tampered")
    return once.join(found, "hash", "left").select("hash", "type", state.alias("state"), "size")


def report(classified: DataFrame) -> DataFrame:
    """One row: is_valid, counts by state, bytes of intact objects."""
    count = lambda s: F.count_if(F.col("state") == s)
    return classified.agg(
        (count("ok") == F.count(F.lit(1))).alias("is_valid"),
        count("ok").alias("n_verified"),
        count("missing").alias("n_missing"),
        count("tampered").alias("n_tampered"),
        F.coalesce(F.sum(F.when(F.col("state") == "ok", F.col("size"))), F.lit(0)).alias("bytes_verified"),
    )
