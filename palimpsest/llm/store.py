"""Content-addressed store of token ids.

Layout below one folder, all Parquet:

``recipes``   a row per document in ascending id order: part, row, doc_id, start_in_part, n_tokens, the digests and
              lengths of its chunks, and a leaf digest over all of these. Rows lie in the files in that order.
``objects``   ``kind=chunk`` holds each distinct chunk once: digest and ids, little-endian and 2 or 4 bytes wide by the
              vocabulary's size; ``kind=recipe`` holds the recipes as they were made, before they were put in order.
``manifest``  a row per part: documents, ids, and the Merkle root over its leaves.

A chunk ends where a rolling hash over the last 16 ids has its 9 top bits clear, after at least ``LEAST`` and at
most ``MOST`` ids, or with its document, so equal passages give equal chunks wherever they stand. The digest of a
chunk is the 16-byte BLAKE2b of its ids as 32-bit words.

Reading back needs no document in one place: each stored chunk is checked against its digest and gives its length
and crc32; a document's crc32 is combined from those in recipe order, and leaves and roots are recomputed.
``reconstruct`` joins the ids themselves.

Defined results: a null or empty text is the end id alone; null ids come first, and rows of equal id follow each
other by the digest of their ids; other columns are left out and may have any name; no rows give empty tables.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import with_end
from .staging import Staging, bound_arrow_batches, shuffle_partitions, trimmed
from .wordids import encode_texts, library_table, one_array, slices

LEAST, MOST, WINDOW, CUT_BITS = 64, 4096, 16, 9
#: Digests that a task remembers while it encodes, so that a chunk it has just met is not sent again.
RECENT = 100_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash allows a cut, without regard to sizes."""
    if len(ids) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    x = _mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = np.zeros(len(ids) - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x5851F42D4C957F2D) + x[k : len(x) - WINDOW + 1 + k]
    return np.flatnonzero(_mixed(h) >> np.uint64(64 - CUT_BITS) == 0) + WINDOW


def chunk_bounds(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each document the bounds of its chunks, first and last included."""
    cuts, out = cut_points(ids).tolist(), []
    k = 0
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        edges = [start]
        while k < len(cuts) and cuts[k] < end:
            c = cuts[k]
            k += 1
            if c - WINDOW < start:  # its window reaches into the document before
                continue
            while c - edges[-1] > MOST:
                edges.append(edges[-1] + MOST)
            if c - edges[-1] >= LEAST:
                edges.append(c)
        while end - edges[-1] > MOST:
            edges.append(edges[-1] + MOST)
        if end > edges[-1]:
            edges.append(end)
        out.append(edges)
    return out


def leaf_digest(doc_id: int | None, n: int, digests: list[bytes], lengths: list[int]) -> bytes:
    head = struct.pack("<?qq", doc_id is None, doc_id or 0, n)
    return hashlib.blake2b(head + b"".join(digests) + np.asarray(lengths, dtype="<u4").tobytes(), digest_size=16).digest()


class MerkleRoot:
    """Root of a binary Merkle tree over leaves that arrive in order; keeps one node a level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for k, held in enumerate(self.levels):
            if held is None:
                self.levels[k] = node
                return
            node, self.levels[k] = hashlib.blake2b(b"\x01" + held + node, digest_size=16).digest(), None
        self.levels.append(node)

    def root(self) -> bytes:
        out = b""
        for held in self.levels:
            if held is not None:
                out = hashlib.blake2b(b"\x01" + held + out, digest_size=16).digest() if out else held
        return out


RAW = "kind string, key binary, doc_id long, n_tokens long, digests array<binary>, lengths array<int>, body binary"
_RAW = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("body", pa.binary())])
RECIPES = "kind int, part int, row long, doc_id long, start_in_part long, n_tokens long, digests array<binary>, lengths array<int>, leaf binary"
_RECIPES = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("leaf", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _encoder(vocabulary: str, end_id: int, width: str):
    """Recipe rows of documents, and chunk rows: each chunk about once a task."""

    def encode(batches):
        table, written, step = library_table(vocabulary), set(), np.dtype(width).itemsize
        for batch in batches:
            texts, keys = one_array(batch.column(1)), batch.column(0).to_pylist()
            for lo, hi in slices(texts):
                ids, bounds = with_end(*encode_texts(texts.slice(lo, hi - lo), table), end_id)
                raw, narrow, rows = memoryview(ids.astype("<u4").tobytes()), memoryview(ids.astype(width).tobytes()), []
                for key, edges in zip(keys[lo:hi], chunk_bounds(ids, bounds), strict=True):
                    digests = [hashlib.blake2b(raw[4 * a : 4 * b], digest_size=16).digest() for a, b in zip(edges, edges[1:])]
                    for d, a, b in zip(digests, edges, edges[1:]):
                        if d not in written:
                            if len(written) >= RECENT:
                                written.clear()
                            written.add(d)
                            rows.append(("chunk", d, None, None, None, None, bytes(narrow[step * a : step * b])))
                    name = hashlib.blake2b(b"".join(digests), digest_size=16).digest()
                    rows.append(("recipe", name, key, edges[-1] - edges[0], digests, [b - a for a, b in zip(edges, edges[1:])], None))
                yield _rows(rows, _RAW)

    return encode


def _once(batches):
    """Of rows in order of kind and key: drops the chunks that the row before has too; recipes stay."""
    last = None
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(kind == "recipe" or key != last)
            if kind == "chunk":
                last = key
        yield batch.filter(pa.array(keep, pa.bool_()))


def _numbered(batches):
    """Recipes in order, with places and leaves; last, the part's manifest row (kind 1)."""
    tree, part, row, start = MerkleRoot(), None, 0, 0
    for batch in batches:
        rows = []
        for part, key, n, digests, lengths in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            tree.add(leaf := leaf_digest(key, n, digests, lengths))
            rows.append((0, part, row, key, start, n, digests, lengths, leaf))
            row, start = row + 1, start + n
        yield _rows(rows, _RECIPES)
    if row:
        yield _rows([(1, part, row, None, start, start, None, None, tree.root())], _RECIPES)


def write_store(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> None:
    """Encode documents and write the store to ``folder``. ``wide``: 4 bytes an id, for vocabularies over 65,536.

    Texts stay where they are read. Chunks move once, by digest, to the task that writes them; recipes, some
    30 bytes a chunk, go by digest and document, so copies of one text are dealt over all tasks, and are put in order.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    staging = Staging(spark, "store")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = chosen.mapInArrow(trimmed(_encoder(vocabulary, end_id, "<u4" if wide else "<u2")), RAW)
    dealt = encoded.repartition(F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64("key", "doc_id")))
    raw = dealt.sortWithinPartitions("kind", "key").mapInArrow(trimmed(_once), RAW)
    raw.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/objects")
    staging.release()
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    unordered = spark.read.schema(RAW).parquet(f"{folder}/objects").where("kind = 'recipe'").select("doc_id", "key", "n_tokens", "digests", "lengths")
    ordered = unordered.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    staged = staging.write(ordered.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "digests", "lengths").mapInArrow(trimmed(_numbered), RECIPES), "numbered")
    staged.where("kind = 0").drop("kind").write.mode("overwrite").parquet(f"{folder}/recipes")
    staged.where("kind = 1").select("part", F.col("row").alias("documents"), "n_tokens", F.col("leaf").alias("root")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    staging.drop("numbered")
    staging.release()


def _open(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = spark.read.schema(RAW).parquet(f"{folder}/objects").where("kind = 'chunk'").select(F.col("key").alias("digest"), "body")
    return spark.read.parquet(f"{folder}/recipes"), chunks, spark.read.parquet(f"{folder}/manifest")


#: x^k mod the reflected CRC-32 polynomial, as bit patterns (fixed values of the checksum).
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    out, bit = 0, 1 << 31
    while True:
        if a & bit:
            out ^= b
            if not a & (bit - 1):
                return out
        bit >>= 1
        b = (b >> 1) ^ POLYNOMIAL if b & 1 else b >> 1


@functools.lru_cache(maxsize=1 << 14)
def _shift(n_bytes: int) -> int:
    """x to the power 8 n_bytes, by which a checksum moves past n_bytes."""
    out, square, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            out = _times(square, out)
        square, n = _times(square, square), n >> 1
    return out


def joined_crc32(parts: list[tuple[int, int]]) -> int:
    """crc32 of strings end to end, from the (crc32, bytes) of each."""
    out = 0
    for crc, n in parts:
        out = _times(_shift(n), out) ^ crc if out else crc
    return out


def read_documents(spark: SparkSession, folder: str, wide: bool = False) -> DataFrame:
    """Read a store back: doc_id, start, n_tokens, ids_crc32, n_chunks; each chunk, leaf and root is checked.

    A mismatch, a missing chunk, and a missing or repeated row or part raise an error: roots, counts and places at
    once, chunks and leaves when the result is read.
    """
    for part in verify_roots(spark, folder).where("not intact").select("part").sort("part").take(1):
        raise ValueError(f"part {part[0]} does not match its digest and counts in the manifest")
    recipes, chunks, manifest = _open(spark, folder)
    width = "<u4" if wide else "<u2"

    def checked(batches):
        for batch in batches:
            lengths, sums = [], []
            for digest, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(body, dtype=width).astype("<u4").tobytes()
                if hashlib.blake2b(words, digest_size=16).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} does not match its digest")
                lengths.append(len(words) // 4)
                sums.append(zlib.crc32(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())], names=["digest", "length", "crc"])

    stored = chunks.mapInArrow(trimmed(checked), "digest binary, length int, crc long")
    refs = recipes.select("part", "row", F.posexplode(F.arrays_zip("digests", "lengths"))).select("part", "row", "pos", F.col("col.digests").alias("digest"))
    found = refs.join(stored, "digest", "left").groupBy("part", "row").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("length").alias("n"), "crc"))).alias("found"))
    joined = recipes.join(found, ["part", "row"], "left")

    def combined(batches):
        for batch in batches:
            sums = []
            cols = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("doc_id", "n_tokens", "digests", "lengths", "leaf", "found")]
            for key, n, digests, lengths, leaf, found in zip(*cols, strict=True):
                found = found or []
                if [x["n"] for x in found] != lengths or sum(lengths) != n or leaf_digest(key, n, digests, lengths) != leaf:
                    raise ValueError(f"document {key} cannot be put together from its recipe")
                sums.append(joined_crc32([(x["crc"], 4 * x["n"]) for x in found]))
            cols = [batch.column(batch.schema.get_field_index(x)) for x in ("part", "row", "doc_id", "start_in_part", "n_tokens", "leaf")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sums, pa.int64()), pa.array(map(len, batch.column(batch.schema.get_field_index("lengths")).to_pylist()), pa.int32())], names=["part", "row", "doc_id", "start_in_part", "n_tokens", "leaf", "ids_crc32", "n_chunks"])

    documents = joined.mapInArrow(trimmed(combined), "part int, row long, doc_id long, start_in_part long, n_tokens long, leaf binary, ids_crc32 long, n_chunks int")
    # one row a part: the number of parts, not of documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return documents.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", "n_chunks", "part", "row")


def verify_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Per part: whether the recipes' leaves, in order and each in its place, give the manifest's Merkle root and counts.
    A part that stands in the manifest more than once isn't intact."""
    leaves = spark.read.parquet(f"{folder}/recipes").select("part", "row", "n_tokens", "leaf", "start_in_part").repartitionByRange("part").sortWithinPartitions("part", "row")

    def roots(batches):
        trees: dict[int, list] = {}
        for batch in batches:
            for part, row, n, leaf, start in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held = trees.setdefault(part, [MerkleRoot(), 0, 0, True])
                held[0].add(leaf)
                held[3] = held[3] and (row, start) == (held[1], held[2])
                held[1] += 1
                held[2] += n
        rows = [(p, t.root() if placed else None, k, n) for p, (t, k, n, placed) in trees.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["part", "found_root", "found_documents", "found_tokens"])

    found = leaves.mapInArrow(trimmed(roots), "part int, found_root binary, found_documents long, found_tokens long")
    manifest = spark.read.parquet(f"{folder}/manifest").withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("part")))  # a row a part
    same = (F.col("times") == 1) & F.col("root").eqNullSafe(F.col("found_root")) & F.col("documents").eqNullSafe(F.col("found_documents")) & F.col("n_tokens").eqNullSafe(F.col("found_tokens"))
    return manifest.join(found, "part", "full").select("part", "documents", "n_tokens", F.coalesce(same, F.lit(False)).alias("intact"))


def reconstruct(spark: SparkSession, folder: str, wide: bool = False) -> DataFrame:
    """The documents' ids themselves: part, row, doc_id, ids (binary, as stored)."""
    recipes, chunks, _ = _open(spark, folder)
    refs = recipes.select("part", "row", "doc_id", F.posexplode("digests").alias("pos", "digest"))
    whole = refs.join(chunks, "digest").groupBy("part", "row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("bodies"))

    def put_together(batches):
        for batch in batches:
            ids = [b"".join(x["body"] for x in bodies) for bodies in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["part", "row", "doc_id", "ids"])

    return whole.mapInArrow(trimmed(put_together), "part int, row long, doc_id long, ids binary")
