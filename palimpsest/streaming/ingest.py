"""Streams into the object store and over the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.objects import ObjectStore


def ingest_objects(stream: DataFrame, store: ObjectStore, checkpoint: str, column: str = "data") -> StreamingQuery:
    """Put each micro-batch; a batch that is run again adds nothing, since objects are addressed by content."""

    def put(batch: DataFrame, _: int) -> None:
        store.put(batch, column)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transaction_states(events: DataFrame) -> DataFrame:
    """tx_id, status, seq: the latest status of each transaction of a stream of journal events (update mode)."""
    return events.where("status <> 'BLOB'").groupBy("tx_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
