"""Exact repeated passages by fixed-block anchors.

A window is ``window`` consecutive words of one document; it is a repeat if the same word sequence also starts
earlier (in a document of a smaller id, or earlier in the same one). Every word that a repeat covers is removed.

1. Index and probe. The index holds non-overlapping blocks of ``window // 2`` words, from each document's first
   word on, so any window holds a whole block. The probes are the runs of that length at every word. A probe that
   meets an indexed block elsewhere is a hit. Probes travel as packed arrays: one row per slice of documents and
   bucket of hashes, sorted, 8 bytes an entry; a hash that a slice holds more than once is a hit there already
   and travels once, so a passage that a third of all documents share is one entry a slice. A task takes its
   buckets one after the other and holds one at a time.
2. Extend. Hits are widened to all windows that hold them, and those are compared whole: by a 96-bit hash, each
   slice sends the earliest start of each window content, the rest being repeats already; the smallest start over
   all slices is the original. What the windows cover together are the maximal exact repeats.
3. Cut. The covered words are taken out of the texts.

Defined results: a null or empty text has no words; starts in rows of one id and text tie, and ties are no
repeats of each other; null ids come last in the order; a text without repeats keeps its words, joined by one space
where a text is returned; other columns are left out and may have any name; no rows give no rows.
"""

from __future__ import annotations

import hashlib

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging, bound_arrow_batches, shuffle_partitions, trimmed
from .wordids import one_array, slices
from .words import Runs, Words

LAST = np.iinfo(np.int64).max
ROW = "slice long, bucket int, n int, a binary, b binary, c binary"
_NAMES = ["slice", "bucket", "n", "a", "b", "c"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=_NAMES)


def _low_first(x: np.ndarray) -> bytes:
    """The bytes of an array, all lowest bytes first: sorted numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_low_first(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _document_row(number: int, ids: np.ndarray, marks: np.ndarray, bounds: np.ndarray) -> tuple:
    """The row that takes a slice's documents along (bucket -1): ids, marks of the texts, first words."""
    return (number, -1, len(ids), ids.astype("<i8").tobytes(), marks.astype("<i8").tobytes(), bounds.astype("<i8").tobytes())


def _slice_number(count: int) -> int:
    return (TaskContext.get().partitionId() << 32) | count


def _bucketed(hashes: np.ndarray, order: np.ndarray, buckets: int):
    """Bounds of each bucket in hashes[order], buckets by the top bits."""
    top = hashes[order] >> np.uint64(64 - (buckets.bit_length() - 1)) if buckets > 1 else np.zeros(len(order), dtype=np.uint64)
    return np.searchsorted(top, np.arange(buckets + 1, dtype=np.uint64))


def _buckets(spark) -> int:
    return 1 << (4 * shuffle_partitions(spark) - 1).bit_length()


def _columns(batch: pa.RecordBatch):
    """Rows of a batch as tuples."""
    return zip(*(batch.column(i).to_pylist() for i in range(len(_NAMES))), strict=True)


def _probes(block: int, buckets: int):
    """Per slice: the packed probes of each bucket, hits within the slice (bucket -2), and its documents."""
    shift = np.uint64(32 - (buckets.bit_length() - 1))

    def run(batches):
        count = 0
        for batch in batches:
            ids, texts, marks = (one_array(batch.column(i)) for i in range(3))
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo), lower=False)
                number, count = _slice_number(count), count + 1
                total = len(words.hashes)
                size = np.maximum(np.diff(words.bounds) - block + 1, 0)
                first = np.repeat(words.bounds[:-1], size)
                start = np.arange(size.sum()) + np.repeat(words.bounds[:-1] - (np.cumsum(size) - size), size)
                rows = [_document_row(number, ids.slice(lo, hi - lo).fill_null(LAST).to_numpy(), marks.slice(lo, hi - lo).to_numpy(), words.bounds)]
                if total and len(start):
                    hashes = Runs(words.hashes)(start, start + block)
                    order = np.argsort(hashes)
                    ranked = hashes[order]
                    same = ranked[1:] == ranked[:-1]
                    again = np.zeros(len(order), dtype=bool)
                    again[1:] |= same
                    again[:-1] |= same
                    rows.append((number, -2, int(again.sum()), start[order[again]].astype("<u4").tobytes(), None, None))
                    # one entry for each distinct hash; its place is the word, or none where the hash stands again
                    lead = np.concatenate([[True], ~same])
                    aligned = ((start - first) % block == 0)[order]
                    groups = np.flatnonzero(lead)
                    indexed = np.logical_or.reduceat(aligned, groups)
                    entry = order[groups]
                    place = np.where(again[groups], 0x7FFFFFFF, start[entry]).astype(np.uint32) | (indexed.astype(np.uint32) << np.uint32(31))
                    rest = (hashes[entry] >> shift).astype(np.uint32)
                    edges = _bucketed(hashes, entry, buckets)
                    for k in range(buckets):
                        if edges[k + 1] > edges[k]:
                            a, b = edges[k], edges[k + 1]
                            rows.append((number, k, int(b - a), _low_first(rest[a:b]), _low_first(place[a:b]), None))
                yield _batch(rows)

    return run


def _by_bucket(solve: Callable[[list[tuple]], list[tuple]]):
    """``solve`` on the rows of each bucket, which come in order of bucket. Rows of buckets under 0 pass."""

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            passing = pc.less(batch.column(1), 0)
            if pc.any(passing).as_py():
                yield batch.filter(passing)
                batch = batch.filter(pc.invert(passing))
            for row in _columns(batch):
                if held and row[1] != held[0][1]:
                    if out := solve(held):
                        yield _batch(out)
                    held = []
                held.append(row)
        if held and (out := solve(held)):
            yield _batch(out)

    return run


def _met(rows: list[tuple]) -> list[tuple]:
    """Probes of one bucket that meet an indexed block in another slice."""
    rest = np.concatenate([_from_low_first(r[3], "<u4") for r in rows])
    place = np.concatenate([_from_low_first(r[4], "<u4") for r in rows])
    origin = np.repeat(np.arange(len(rows)), [r[2] for r in rows])
    order = np.argsort(rest, kind="stable")
    ranked = rest[order]
    groups = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.concatenate([groups, [len(ranked)]]))
    indexed = np.logical_or.reduceat((place[order] >> np.uint32(31)).astype(bool), groups)
    hit = np.repeat((size > 1) & indexed, size)
    chosen = order[hit]
    word = place[chosen] & np.uint32(0x7FFFFFFF)
    chosen, word = chosen[word != 0x7FFFFFFF], word[word != 0x7FFFFFFF]
    return _sent_back(rows, origin[chosen], word)


def _sent_back(rows: list[tuple], origin: np.ndarray, word: np.ndarray) -> list[tuple]:
    """Places of words as rows (bucket -2) of the slices that they stand in."""
    by = np.argsort(origin, kind="stable")
    edges = np.searchsorted(origin[by], np.arange(len(rows) + 1))
    return [(r[0], -2, int(b - a), word[by[a:b]].astype("<u4").tobytes(), None, None) for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True) if b > a]


PLACES = "doc_id long, mark long, places binary"


def _by_document(batches):
    """Rows of whole slices, in order of slice: the places of each document that has some."""
    number: int | None = None
    held: list[tuple] = []

    def split(rows):
        found = [np.frombuffer(r[3], dtype="<u4") for r in rows if r[1] == -2]
        documents = next(r for r in rows if r[1] == -1)
        ids, marks, bounds = (np.frombuffer(documents[i], dtype="<i8") for i in (3, 4, 5))
        places = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype="<u4")
        edges = np.searchsorted(places, bounds)
        own = np.flatnonzero(edges[1:] > edges[:-1])
        lists = [(places[edges[i] : edges[i + 1]].astype(np.int64) - bounds[i]).astype("<u4").tobytes() for i in own]
        return pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pa.array(marks[own], pa.int64()), pa.array(lists, pa.binary())], names=["doc_id", "mark", "places"])

    for batch in batches:
        for row in _columns(batch):
            if row[0] != number and held:
                yield split(held)
                held = []
            number = row[0]
            held.append(row)
    if held:
        yield split(held)


def _per_document(df: DataFrame) -> DataFrame:
    """From rows of slices to one row per document with places."""
    return df.repartition("slice").sortWithinPartitions("slice").mapInArrow(trimmed(_by_document), PLACES)


def _united(found: DataFrame) -> DataFrame:
    """One row a document, should equal rows stand in several slices."""
    return found.groupBy("doc_id", "mark").agg(F.collect_set("places").alias("places"))


def _windows(window: int, block: int, buckets: int):
    """Per slice of documents with hits: the earliest start of each content of their windows, packed, the later
    ones as repeats (bucket -2), and the documents."""

    def run(batches):
        count = 0
        for batch in batches:
            ids, texts, marks, places = (one_array(batch.column(i)) for i in range(4))
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo), lower=False)
                number, count = _slice_number(count), count + 1
                ids_here = ids.slice(lo, hi - lo).fill_null(LAST).to_numpy()
                starts, docs = [], []
                for i, lists in enumerate(places.slice(lo, hi - lo).to_pylist()):
                    begin, end = int(words.bounds[i]), int(words.bounds[i + 1])
                    if end - begin < window:
                        continue
                    # windows from (hit - window + block) to hit hold the hit whole
                    hits = np.concatenate([np.frombuffer(x, dtype="<u4") for x in lists]).astype(np.int64)
                    n = end - begin - window + 1
                    steps = np.zeros(n + 1, dtype=np.int64)
                    low, high = np.maximum(hits - window + block, 0), np.minimum(hits + 1, n)
                    fits = low < high
                    np.add.at(steps, low[fits], 1)
                    np.add.at(steps, high[fits], -1)
                    own = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
                    starts.append(own + begin)
                    docs.append(np.full(len(own), i))
                rows = [_document_row(number, ids_here, marks.slice(lo, hi - lo).to_numpy(), words.bounds)]
                start = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
                if len(start):
                    doc = np.concatenate(docs)
                    hashes = Runs(words.hashes)(start, start + window)
                    check = (Runs(words.hashes, 0x3C6EF372FE94F82B)(start, start + window) >> np.uint64(32)).astype(np.uint32)
                    within = start - words.bounds[doc]
                    order = np.lexsort((within, ids_here[doc], check, hashes))
                    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (check[order][1:] != check[order][:-1])])
                    lead = np.flatnonzero(new)
                    head = np.repeat(order[lead], np.diff(np.concatenate([lead, [len(order)]])))
                    later = (ids_here[doc[order]] > ids_here[doc[head]]) | (within[order] > within[head])
                    rows.append((number, -2, int(later.sum()), start[order[later]].astype("<u4").tobytes(), None, None))
                    # equal rows of one document tie: they stand or fall together, so all of them are sent
                    first = order[~later]
                    edges = _bucketed(hashes, first, buckets)
                    for k in range(buckets):
                        if edges[k + 1] > edges[k]:
                            f = first[edges[k] : edges[k + 1]]
                            packed = _low_first(ids_here[doc[f]].astype("<i8")) + _low_first(within[f].astype("<u4"))
                            rows.append((number, k, len(f), _low_first(hashes[f]) + _low_first(check[f]), packed, _low_first(start[f].astype("<u4"))))
                yield _batch(rows)

    return run


def _later_copies(rows: list[tuple]) -> list[tuple]:
    """Windows of one bucket whose content starts earlier in another slice."""
    hashes = np.concatenate([_from_low_first(r[3][: 8 * r[2]], "<u8") for r in rows])
    check = np.concatenate([_from_low_first(r[3][8 * r[2] :], "<u4") for r in rows])
    ids = np.concatenate([_from_low_first(r[4][: 8 * r[2]], "<i8") for r in rows])
    within = np.concatenate([_from_low_first(r[4][8 * r[2] :], "<u4") for r in rows])
    place = np.concatenate([_from_low_first(r[5], "<u4") for r in rows])
    origin = np.repeat(np.arange(len(rows)), [r[2] for r in rows])
    order = np.lexsort((within, ids, check, hashes))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (check[order][1:] != check[order][:-1])])
    lead = np.flatnonzero(new)
    head = np.repeat(order[lead], np.diff(np.concatenate([lead, [len(order)]])))
    later = order[(ids[order] > ids[head]) | ((ids[order] == ids[head]) & (within[order] > within[head]))]
    return _sent_back(rows, origin[later], place[later])


def repeated_windows(docs: DataFrame, window: int, staging: Staging) -> DataFrame:
    """(doc_id, mark, places): the starts of each document's repeats, for documents (doc_id, text, mark) that have some."""
    if window < 2:
        raise ValueError("a window has at least 2 words")
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    block = (window + 1) // 2  # any window of 2 * block - 1 words or more holds a whole block
    buckets = _buckets(spark)

    tasks = shuffle_partitions(spark)

    def dealt(df: DataFrame) -> DataFrame:
        # buckets in turn, so that tasks have equally many; rows that only pass through by their slice
        turn = F.when(F.col("bucket") < 0, F.xxhash64("slice")).otherwise(F.col("bucket").cast("long"))
        return df.repartitionById(tasks, F.pmod(turn, F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")

    hits = staging.write(lambda: _per_document(dealt(docs.select("doc_id", "text", "mark").mapInArrow(trimmed(_probes(block, buckets)), ROW)).mapInArrow(trimmed(_by_bucket(_met)), ROW)), "hits", moved_much=True)
    hit_docs = docs.select("doc_id", "text", "mark").join(_united(hits).withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m"), (F.coalesce("doc_id", F.lit(int(LAST))) == F.col("d")) & (F.col("mark") == F.col("m")))
    # slices are numbered by task and order, so the order must be the same should a task run again
    ordered = hit_docs.sortWithinPartitions("d", "m")
    found = staging.write(lambda: _per_document(dealt(ordered.select("doc_id", "text", "mark", "places").mapInArrow(trimmed(_windows(window, block, buckets)), ROW)).mapInArrow(trimmed(_by_bucket(_later_copies)), ROW)), "repeats", moved_much=True)
    staging.drop("hits")
    return found


def cut_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then struct ``cut``: n_words, n_removed, kept_text (kept words joined by one space; the
    text as it is where nothing is removed) and kept_sha256 (of the kept words joined by one space).

    A column of ``docs`` that is named cut gives way to the result. Ids are taken as 64-bit numbers.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "cut"))
    staging = Staging(spark, "substring")
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mark"))
    repeats = _united(repeated_windows(marked, window, staging)).select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), F.col("places").alias("__places"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("__id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__mark"))
    joined = whole.join(repeats, (F.col("__id") == F.col("__d")) & (F.col("__mark") == F.col("__m")), "left").select("__row", "__places")
    text_at = docs.columns.index(text_col)
    cut = "struct<n_words: bigint, n_removed: bigint, kept_text: string, kept_sha256: string>"
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for text, lists in zip(batch.column(0).field(text_at).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                removed, kept = 0, words
                if lists:
                    starts = np.concatenate([np.frombuffer(x, dtype="<u4") for x in lists]).astype(np.int64)
                    steps = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(steps, starts, 1)
                    np.add.at(steps, starts + window, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    removed = int(gone.sum())
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                joined = b" ".join(kept)
                out.append({"n_words": len(words), "n_removed": removed, "kept_text": joined.decode() if removed else text, "kept_sha256": hashlib.sha256(joined).hexdigest()})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["__row", "cut"])

    row = joined.schema["__row"].dataType.simpleString()
    return joined.mapInArrow(trimmed(run), f"__row {row}, cut {cut}").select("__row.*", "cut")
