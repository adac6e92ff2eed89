"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` ids; pieces go into as few sequences as the heuristic
finds. Only the lengths matter for that, so the plan is made from the histogram of lengths, which has at most
``capacity`` entries whatever the corpus holds: for each bin the longest piece left is taken and a bitset
subset-sum over the lengths left finds the fullest combination beside it. The combination is removed as often as
its lengths last. Pieces then take their places by their rank among pieces of equal length; ranks are counted
within salted groups, so a length that a third of all pieces share is no group of its own.

Defined results: a null or empty text is a document of the end id alone; equal rows are pieces in their own
right; a null id is carried along; other columns are left out and may have any name; no rows give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import Staging, bound_arrow_batches, shuffle_partitions, trimmed
from .wordids import encode_texts, library_table, one_array, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each document's ids."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, dtype=np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, bounds + np.arange(n + 1)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, number, start, length and the crc32 of its ids as little-endian 32-bit words."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    bound_arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def pieces(batches):
        table = library_table(vocabulary)
        for batch in batches:
            texts, keys = one_array(batch.column(1)), one_array(batch.column(0))
            for lo, hi in slices(texts):
                ids, bounds = with_end(*encode_texts(texts.slice(lo, hi - lo), table), end_id)
                counts = -(-np.diff(bounds) // capacity)
                doc = np.repeat(np.arange(hi - lo), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(np.diff(bounds)[doc] - start, capacity)
                raw, at = memoryview(ids.astype("<u4").tobytes()), (bounds[doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(pieces), PIECES)


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How often to take each length so that the sum is the largest one within ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, times = min(counts[length], room // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left, times = left - times, times * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + times
            total -= length * times
    return taken


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, first sequence, times a bin, offset) and the number of bins."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths = sorted(counts, reverse=True)
    used, rows, bins = dict.fromkeys(counts, 0), [], 0
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        taken = fullest(capacity - longest, lengths, counts)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        repeats, offset = min(counts[k] // m for k, m in taken.items()), 0
        for length in sorted(taken, reverse=True):
            rows.append((length, used[length], bins, taken[length], offset))
            used[length] += taken[length] * repeats
            counts[length] -= taken[length] * repeats
            offset += taken[length] * length
        bins += repeats
        if any(not counts[k] for k in taken):
            lengths = [k for k in lengths if counts[k]]
    return rows, bins


def pack(pieces: DataFrame, capacity: int, staging: Staging) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces (columns as in ``PIECES``).

    A sequence's pieces lie end to end from offset 0 and hold at most ``capacity`` ids.
    """
    spark = pieces.sparkSession
    # at most one row a length, so at most capacity rows
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError("piece lengths must be from 1 to capacity")
    rows, _ = minimum_bin_slack(histogram, capacity)
    plan = np.array(sorted(rows) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    rule = spark.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan))

    salts = 4 * shuffle_partitions(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(groups, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches):
        keys, plan = rule.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = plan[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            turn = rank - row[:, 1]
            sequence = row[:, 2] + turn // row[:, 3]
            offset = row[:, 4] + turn % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(place), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents, cut those over ``capacity`` ids, and place every piece."""
    staging = Staging(docs.sparkSession, "packing")
    pieces = staging.write(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, capacity, staging)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), for documents whose ids differ."""

    def ids_of(batches):
        table = library_table(vocabulary)
        for batch in batches:
            ids, bounds = with_end(*encode_texts(one_array(batch.column(1)), table), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(ids_of), "doc_id long, ids array<int>")
    cut = placed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
