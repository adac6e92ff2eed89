"""A journal of transactions as an append-only table of events, and recovery over it.

Events: tx_id, seq, status (PREPARING, BLOB, COMMITTED, CLOSED), kind, at, payload. The last status of a
transaction is its state; a closed one is gone.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

SCHEMA = "tx_id string, seq bigint, status string, kind string, at double, payload string"


def open_transactions(events: DataFrame) -> DataFrame:
    """tx_id, kind, status, created_at, blobs of transactions that are not closed."""
    last = F.max_by("status", F.when(F.col("status") != "BLOB", F.col("seq")))
    grouped = events.groupBy("tx_id").agg(F.min_by("kind", "seq").alias("kind"), last.alias("status"), F.min("at").alias("created_at"), F.sort_array(F.collect_set(F.when(F.col("status") == "BLOB", F.col("payload")))).alias("blobs"))
    return grouped.where("status is null or status <> 'CLOSED'")


def recovery_report(transactions: DataFrame, status: str = "status") -> DataFrame:
    """One row: n_aborted (begun and not committed), n_completed, n_unreadable (no known status; removed uncounted)."""
    known = F.col(status).isin("PREPARING", "COMMITTED")
    return transactions.agg(
        F.count_if(known & (F.col(status) != "COMMITTED")).alias("n_aborted"),
        F.count_if(F.coalesce(F.col(status) == "COMMITTED", F.lit(False))).alias("n_completed"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("n_unreadable"),
    )


def orphans(objects: DataFrame, reachable: DataFrame) -> DataFrame:
    """Objects that no branch needs. They are reported and kept."""
    return objects.join(reachable.select("hash").distinct(), "hash", "left_anti")


class Journal:
    """The events of one repository."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/journal"

    def _append(self, tx_id: str, status: str, kind: str = "", payload: str = "") -> None:
        row = (tx_id, time.time_ns(), status, kind, time.time(), payload)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path) if files.exists(self.spark, self.path) else self.spark.createDataFrame([], SCHEMA)

    def begin(self, kind: str, details: dict | None = None) -> str:
        tx_id = uuid.uuid4().hex
        self._append(tx_id, "PREPARING", kind, json.dumps(details or {}, sort_keys=True))
        return tx_id

    def record_blobs(self, tx_id: str, objects: DataFrame) -> None:
        """Note the objects (column hash) that a transaction stores."""
        rows = objects.where("hash is not null").select("hash").distinct()
        made = rows.select(F.lit(tx_id).alias("tx_id"), F.lit(time.time_ns()).alias("seq"), F.lit("BLOB").alias("status"), F.lit("").alias("kind"), F.lit(time.time()).alias("at"), F.col("hash").alias("payload"))
        made.coalesce(1).write.mode("append").parquet(self.path)

    def mark_committed(self, tx_id: str, commit_id: str) -> None:
        self._append(tx_id, "COMMITTED", payload=commit_id)

    def close(self, tx_id: str) -> None:
        self._append(tx_id, "CLOSED")

    def recover(self, older_than: float = 0.0) -> dict[str, int]:
        """Close what has been open for ``older_than`` seconds; how many were aborted and completed."""
        pending = open_transactions(self.events()).where(F.col("created_at") <= time.time() - older_than).persist()
        found = recovery_report(pending).first().asDict()
        if sum(found.values()):
            made = pending.select("tx_id", F.lit(time.time_ns()).alias("seq"), F.lit("CLOSED").alias("status"), F.lit("").alias("kind"), F.lit(time.time()).alias("at"), F.lit("").alias("payload"))
            made.coalesce(1).write.mode("append").parquet(self.path)
        pending.unpersist()
        return found
