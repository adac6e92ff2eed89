"""Near-duplicate documents by SuperMinHash.

1. Each document becomes a set of word shingles (64-bit hashes of lower-cased words), a SuperMinHash signature of
   128 places and, from it, 32 band keys of 4 places and a 128-bit sketch. An element's ranks at the places are one
   random permutation plus a fraction, so the ranks of one element are correlated and the estimate varies less
   than with independent hashes; ranks are drawn place by place, and a document stops as soon as no
   rank of the next order can fall below its largest one.
2. Equal sets are one class, stood for by its smallest document.
3. Representatives that share a band key are candidates. A pair of similarity 0.8 shares none with a probability
   of 0.5904^32 < 5e-8, one of more with less.
4. Links are verified on the full sets, recomputed from the texts, and joined by union-find. Only components are
   asked for, so the pairs of a group are never made. First each document is verified against one pivot: of the
   smallest documents of its buckets, the one that shares most of them. Then documents that are candidates of each
   other, directly or over others, form a group, and in each group that still holds several components, blocks of
   documents are compared as sparse matrices of their shingles: a pair of blocks gives the full intersections of
   all their pairs at once and passes on a spanning forest of the links between components. Blocks are filled
   in the order of components, and two blocks of one and the same component are not compared.

A pivot is passed over only where the sizes alone exclude the similarity, or where the sketches agree in fewer
bits than those of a similar pair do with a probability over 1e-8; the comparison in blocks passes nothing over.

Defined results: a null text or one without words has an empty set and links with nothing, not even its like;
equal rows come back as often as they stand in the input; of an id with several texts each row goes by its own
text; rows with a null id get a null component and are kept; other columns are left out and may have any name;
no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .staging import Staging, bound_arrow_batches, trimmed
from .wordids import one_array, slices
from .words import Words, mixed, shingles

PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
#: Elements whose permutations are held at once.
HELD = 50_000


def super_min_hash(elements: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures (sets x places) of sets given end to end: order of the rank in the high half, fraction in the low."""
    n, low = len(bounds) - 1, np.uint64(0xFFFFFFFF)
    signature = np.full((n, places), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat, size = signature.reshape(-1), np.diff(bounds)
    doc = np.repeat(np.arange(n), size)
    draw = mixed(elements ^ np.uint64(0x6A09E667F3BCC909))
    first = ((draw >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(flat, doc * places + first, draw & low)
    open_ = (size > 0) & (signature.max(axis=1) >> np.uint64(32) > 0)
    at = np.flatnonzero(open_[doc])
    # whole documents in groups of a bounded number of elements
    cuts, held = [0], 0
    for i, d in zip(np.flatnonzero(open_).tolist(), size[open_].tolist(), strict=True):
        if held and held + d > HELD:
            cuts.append(int(np.searchsorted(doc[at], i)))
            held = 0
        held += d
    for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
        if hi > lo:
            _later_orders(flat, signature, elements[at[lo:hi]], doc[at[lo:hi]], first[at[lo:hi]], places)
    return signature


def _later_orders(flat, signature, elements, doc, first, places) -> None:
    permutation = np.tile(np.arange(places, dtype=np.uint16), (len(elements), 1))
    row = np.arange(len(elements))
    permutation[row, 0], permutation[row, first] = first, 0
    for order in range(1, places):
        draw = mixed(elements + np.uint64((order * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        pick = order + ((draw >> np.uint64(32)) * np.uint64(places - order) >> np.uint64(32)).astype(np.int64)
        place = permutation[row, pick]
        permutation[row, pick] = permutation[row, order]
        permutation[row, order] = place
        np.minimum.at(flat, doc * places + place, np.uint64(order << 32) | (draw & np.uint64(0xFFFFFFFF)))
        docs = np.unique(doc)
        done = np.zeros(docs[-1] + 1, dtype=bool)
        done[docs] = signature[docs].max(axis=1) >> np.uint64(32) <= np.uint64(order)
        keep = ~done[doc]
        if not keep.any():
            return
        if keep.sum() < 0.75 * len(keep):
            elements, doc, permutation = elements[keep], doc[keep], permutation[keep]
            row = np.arange(len(elements))


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band."""
    bands = signature.shape[1] // rows
    parts = mixed(signature.reshape(len(signature), bands, rows) + np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    folded = parts[:, :, 0]
    for k in range(1, rows):
        folded = folded * np.uint64(0x5851F42D4C957F2D) + parts[:, :, k]
    return mixed(folded + np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def sketches(signature: np.ndarray) -> np.ndarray:
    """One random bit of each place, as 64-bit numbers."""
    bits = (mixed(signature ^ np.uint64(0x1F83D9ABFB41BD6B)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def least_agreement(similarity: float, places: int = PLACES, chance: float = 1e-8) -> int:
    """The most bits below which sketches of sets of that similarity agree with a probability of at most ``chance``."""
    p, total, k = (1 + similarity) / 2, 0.0, 0
    while True:
        total += math.comb(places, k) * p**k * (1 - p) ** (places - k)
        if total > chance:
            return k
        k += 1


def set_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each set's sum modulo 2^64, as signed numbers."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


SIGNATURES = "doc_id long, n_shingles long, d0 long, d1 long, s0 long, s1 long, keys array<long>"


def signatures(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """One row per document (columns doc_id, text): set size, 128-bit digest of the set, sketch, band keys."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts, keys = one_array(batch.column(1)), one_array(batch.column(0))
            for lo, hi in slices(texts):
                elements, bounds = shingles(Words(texts.slice(lo, hi - lo), lower=True), words_per_shingle)
                size = np.diff(bounds)
                d0, d1 = (set_sums(mixed(elements ^ np.uint64(salt)), bounds) for salt in (0x510E527FADE682D1, 0x9B05688C2B3E6C1F))
                signature = super_min_hash(elements, bounds)
                sketch = sketches(signature)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]), pa.int32()), pa.array(band_keys(signature)[size > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array(size), pa.array(d0), pa.array(d1), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), lists], names=["doc_id", "n_shingles", "d0", "d1", "s0", "s1", "keys"])

    return docs.mapInArrow(trimmed(run), SIGNATURES)


def verified(pairs: DataFrame, docs: DataFrame, words_per_shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b; b the pivot side) whose full sets have 100 |A & B| >= percent |A | B|."""
    sides = pairs.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    sides = sides.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lo, hi in slices(one_array(batch.column(2))):
                part = table.slice(lo, hi - lo)
                # a pivot's text stands in many rows: its set is made once
                pivots = one_array(part.column(1)).dictionary_encode()
                where = pivots.indices.to_numpy(zero_copy_only=False)
                firsts = np.unique(where, return_index=True)[1]
                a, ab = shingles(Words(one_array(part.column(2)), lower=True), words_per_shingle)
                b, bb = shingles(Words(one_array(part.column(3)).take(pa.array(firsts)), lower=True), words_per_shingle)
                keep = []
                for i, j in enumerate(where.tolist()):
                    x, y = a[ab[i] : ab[i + 1]], b[bb[j] : bb[j + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                kept = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([one_array(part.column(i)).filter(kept) for i in (0, 1)], names=["a", "b"])

    return sides.mapInArrow(trimmed(run), "a long, b long")


#: Documents, and shingles, of a block at most; columns of a matrix.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1 << 18, 8192
BLOCKS = "grp long, low long, high long, ids binary, roots binary, sizes binary, sets binary"


def _blocks(words_per_shingle: int):
    """Blocks of sets from rows (grp, root, doc_id, text) in that order."""
    def row(held):
        ids, roots = (np.array([h[i] for h in held], dtype="<i8") for i in (1, 2))
        sizes = np.array([len(h[3]) for h in held], dtype="<i8")
        packed = [x.tobytes() for x in (ids, roots, sizes, np.concatenate([h[3] for h in held]).astype("<u8"))]
        return (held[0][0], int(roots.min()), int(roots.max()), *packed)

    def batch_of(rows):
        kinds = (pa.int64(),) * 3 + (pa.binary(),) * 4
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            texts, out = one_array(batch.column(3)), []
            for lo, hi in slices(texts):
                elements, bounds = shingles(Words(texts.slice(lo, hi - lo), lower=True), words_per_shingle)
                keys = zip(*(batch.column(i).slice(lo, hi - lo).to_pylist() for i in range(3)), strict=True)
                for (group, root, key), a, b in zip(keys, bounds[:-1], bounds[1:], strict=True):
                    if held and (group != held[0][0] or len(held) >= BLOCK or size + b - a > BLOCK_SHINGLES):
                        out.append(row(held))
                        held, size = [], 0
                    held.append((group, key, root, elements[a:b]))
                    size += int(b - a)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([row(held)])

    return run


def intersections(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets of one block with all of another; sets end to end."""
    out = np.zeros((len(a_sizes), len(b_sizes)), dtype=np.float32)
    common = np.intersect1d(a, b)
    sides = []
    for elements, sizes in ((a, a_sizes), (b, b_sizes)):
        column = np.searchsorted(common, elements)
        there = column < len(common)
        there[there] = common[column[there]] == elements[there]
        sides.append((np.repeat(np.arange(len(sizes)), sizes)[there], column[there]))
    for lo in range(0, len(common), COLUMNS):
        matrices = []
        for (row, column), sizes in zip(sides, (a_sizes, b_sizes), strict=True):
            chosen = (column >= lo) & (column < lo + COLUMNS)
            matrix = np.zeros((len(sizes), min(COLUMNS, len(common) - lo)), dtype=np.float32)
            matrix[row[chosen], column[chosen] - lo] = 1
            matrices.append(matrix)
        out += matrices[0] @ matrices[1].T
    return out.astype(np.int64)


def _compared(percent: int):
    """Spanning forests of the links between different components in pairs of blocks. Rows (pair, block and its
    payload) come in order of pair; a pair of one row is a block with itself."""
    def links(x, y):
        (ids, roots, sizes), (ids_b, roots_b, sizes_b) = ([np.frombuffer(r[i], dtype="<i8") for i in (1, 2, 3)] for r in (x, y))
        both = intersections(np.frombuffer(x[4], dtype="<u8"), sizes, np.frombuffer(y[4], dtype="<u8"), sizes_b)
        either = sizes[:, None] + sizes_b[None, :] - both
        i, j = np.nonzero((both > 0) & (100 * both >= percent * either) & (roots[:, None] != roots_b[None, :]))
        u, v = forest(ids[i], ids_b[j])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and row[0] != held[0][0]:
                    yield links(held[0], held[-1])
                    held = []
                held.append(row)
        if held:
            yield links(held[0], held[-1])

    return run


def links_between(members: DataFrame, texts: DataFrame, words_per_shingle: int, percent: int, staging: Staging) -> DataFrame:
    """Links (a, b) between the components (root) within each group of ``members`` (grp, doc_id, root): enough of them to connect
    whatever is linked."""
    order = ["grp", "root", "doc_id"]
    # a large group is dealt over several tasks by ranges of its components
    rows = members.join(texts, "doc_id").select(*order, "text").repartitionByRange(*order).sortWithinPartitions(*order)
    # numbered, not named by content: blocks of repeated rows hold the same
    blocks = staging.write(lambda: rows.mapInArrow(trimmed(_blocks(words_per_shingle)), BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks")
    names = blocks.select("grp", "block", "low", "high")
    other = names.select("grp", F.col("block").alias("block_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    met = names.join(other, "grp").where("block <= block_b and not (low = high and low_b = high_b and low = low_b)").select("grp", "block", "block_b")
    sides = met.select("grp", F.struct("grp", "block", "block_b").alias("pair"), F.explode(F.array_distinct(F.array("block", "block_b"))).alias("block"))
    pairs = sides.join(blocks.select("grp", "block", "ids", "roots", "sizes", "sets"), ["grp", "block"])
    together = pairs.select(F.to_json("pair").alias("pair"), "ids", "roots", "sizes", "sets").repartition("pair").sortWithinPartitions("pair")
    return together.mapInArrow(trimmed(_compared(percent)), "a long, b long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the smallest document of each group)."""
    spark = docs.sparkSession
    staging = Staging(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = staging.write(signatures(docs, words_per_shingle), "signatures")
    nodes = rows.where("doc_id is not null and n_shingles > 0")
    classes = nodes.groupBy("n_shingles", "d0", "d1").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # written first: adaptive execution splits a hot key, such as that of many copies, in a join of plain tables only
    classes = staging.write(classes.where("n > 1").drop("n"), "classes")
    columns = ["doc_id", "n_shingles", "rep", "s0", "s1", "keys"]
    several = rows.where("n_shingles > 0").join(classes, ["n_shingles", "d0", "d1"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    without = rows.where("n_shingles = 0").withColumn("rep", F.lit(None).cast("long"))
    members_of_classes = staging.write(several.select(*columns).unionAll(without.select(*columns)), "members")
    staging.drop("signatures", "classes")
    reps = members_of_classes.where("doc_id = rep").select("doc_id", "n_shingles", "s0", "s1", "keys").dropDuplicates(["doc_id", "n_shingles", "s0", "s1"])
    reps = staging.write(reps, "representatives")
    bands = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = staging.write(lambda: bands.join(shared.select("key", "pivot"), "key").select("key", "doc_id", "pivot"), "buckets", moved_much=True)

    # the texts of all candidates, moved once
    texts = staging.write(lambda: docs.join(buckets.select("doc_id").distinct(), "doc_id"), "texts", moved_much=True)
    facts = reps.select("doc_id", "n_shingles", "s0", "s1")
    agreement = least_agreement(percent / 100)

    def side(name: str) -> DataFrame:
        return facts.select(F.col("doc_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n_shingles", "s0", "s1")))

    possible = (
        (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
        & (128 - F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) - F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) >= agreement)
    )

    stars = buckets.where("doc_id <> pivot").groupBy(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    stars = staging.write(stars, "stars")
    near = stars.join(side("a"), "a").join(side("b"), "b").where(possible)
    best = near.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
    links = staging.write(lambda: verified(best, texts, words_per_shingle, percent), "links-1")
    roots = staging.write(connected_components(links, staging, "first"), "roots-1")
    groups = staging.write(connected_components(stars.select("a", "b"), staging, "groups"), "groups")

    # groups that hold several components; one of two documents has been verified already
    nodes = buckets.select("doc_id").distinct().join(groups, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("grp"))
    placed = nodes.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "grp", F.coalesce("root", "doc_id").alias("root"))
    several = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 and low <> high").select("grp")
    members = staging.write(placed.join(several, "grp"), "members-of-groups")
    links = staging.write(lambda: links.unionAll(links_between(members, texts, words_per_shingle, percent, staging)), "links-2")
    roots = staging.write(connected_components(links, staging, "second"), "roots-2")
    staging.drop("buckets", "stars", "texts", "blocks", "groups", "members-of-groups", "links-1", "links-2", "roots-1")
    staging.release()
    joined = members_of_classes.select("doc_id", "n_shingles", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
