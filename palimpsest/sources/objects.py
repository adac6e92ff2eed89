"""Content-addressed objects: hash, size, data, in Parquet by the first two digits of the hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import content_hash
from . import files

SCHEMA = "hash string, size bigint, data binary, shard string"


def addressed(data: DataFrame, column: str = "data") -> DataFrame:
    """hash, size, data, shard of a binary or string column; null data is left out."""
    raw = F.col(column).cast("binary")
    return data.where(F.col(column).isNotNull()).select(content_hash(raw).alias("hash"), F.octet_length(raw).cast("long").alias("size"), raw.alias("data")).withColumn("shard", F.substring("hash", 1, 2))


class ObjectStore:
    """A store below one folder. Its shard prunes lookups.

    Writers don't wait for each other, so two of them may store one object twice, and a damaged copy may stand beside a
    good one: every reading takes a hash once, and its intact copy if there is one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/objects"

    def table(self) -> DataFrame:
        """The rows as they are stored."""
        return self.spark.read.schema(SCHEMA).parquet(self.path) if files.exists(self.spark, self.path) else self.spark.createDataFrame([], SCHEMA)

    def contents(self, rows: DataFrame | None = None) -> DataFrame:
        """hash, data, intact: each hash once, of all objects or of chosen ``rows`` of the table."""
        checked = (self.table() if rows is None else rows).select("hash", "data", F.coalesce(content_hash(F.col("data")) == F.col("hash"), F.lit(False)).alias("intact"))
        return checked.groupBy("hash").agg(F.max_by("data", "intact").alias("data"), F.max("intact").alias("intact"))

    def joined(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows`` with the object that ``column`` names as ``name``; null stays null, a missing or altered object raises an error."""
        held = self.contents().select(F.col("hash").alias("__hash"), F.col("data").alias("__data"), F.col("intact").alias("__intact"))
        bad = F.raise_error(F.concat(F.lit("object missing or altered: "), F.col(column))).cast("binary")
        data = F.when(F.col(column).isNull(), F.lit(None).cast("binary")).when(F.coalesce("__intact", F.lit(False)), F.col("__data")).otherwise(bad)
        return rows.join(held, F.col(column) == F.col("__hash"), "left").withColumn(name, data).drop("__hash", "__data", "__intact")

    def put(self, data: DataFrame, column: str = "data") -> int:
        """Store what is not there yet; the number of new objects."""
        rows = addressed(data, column).dropDuplicates(["hash"]).persist()
        shards = [r[0] for r in rows.select("shard").distinct().collect()]  # at most 256
        there = self.table().where(F.col("shard").isin(shards)).select("shard", "hash")
        fresh = rows.join(there, ["shard", "hash"], "left_anti").select("hash", "size", "data", "shard")
        n = fresh.count()
        if n:
            fresh.repartition("shard").write.mode("append").partitionBy("shard").parquet(self.path)
        rows.unpersist()
        return n

    def put_bytes(self, *blobs: bytes) -> list[str]:
        """Store a few objects of the driver; their hashes."""
        from ..functions.canonical import digest

        named = {digest(b): b for b in blobs}
        there = {r[0] for r in self.find(*named).select("hash").distinct().collect()}
        fresh = [(h, len(b), bytearray(b), h[:2]) for h, b in named.items() if h not in there]
        if fresh:
            self.spark.createDataFrame(fresh, SCHEMA).coalesce(1).write.mode("append").partitionBy("shard").parquet(self.path)
        return [digest(b) for b in blobs]

    def find(self, *hashes: str) -> DataFrame:
        """The stored rows of some hashes."""
        return self.table().where(F.col("shard").isin(sorted({h[:2] for h in hashes})) & F.col("hash").isin(list(hashes)))

    def get(self, key: str) -> bytes:
        """An object's bytes; FileNotFoundError if it is missing, ValueError if its bytes don't match its hash."""
        row = self.contents(self.find(key)).first()
        if row is None:
            raise FileNotFoundError(key)
        if not row["intact"]:
            raise ValueError(f"object {key} doesn't match its hash")
        return bytes(row["data"])

    def places(self, key: str) -> list[str]:
        """The files that hold an object, for reading them directly and unchecked."""
        return [r[0] for r in self.find(key).select(F.input_file_name()).distinct().collect()]

    def exists(self, key: str) -> bool:
        return not self.find(key).select("hash").isEmpty()

    def hashes(self) -> DataFrame:
        return self.table().select("hash").distinct()

    def verify(self, key: str) -> bool:
        """False for a missing or altered object."""
        row = self.contents(self.find(key)).select("intact").first()
        return bool(row and row["intact"])

    def present(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (column hash) that the store has."""
        return wanted.join(self.table().select("hash"), "hash", "left_semi")

    def shards(self) -> DataFrame:
        """shard, n_objects, bytes over distinct hashes."""
        once = self.table().groupBy("shard", "hash").agg(F.max("size").alias("size"))
        return once.groupBy("shard").agg(F.count(F.lit(1)).alias("n_objects"), F.sum("size").alias("bytes"))


def dedup_report(objects: DataFrame) -> DataFrame:
    """hash, n_refs, size, saved_bytes: what storing each content once saves. Columns in: hash, size."""
    grouped = objects.groupBy("hash").agg(F.count(F.lit(1)).alias("n_refs"), F.max("size").alias("size"))
    return grouped.withColumn("saved_bytes", (F.col("n_refs") - 1) * F.col("size"))
