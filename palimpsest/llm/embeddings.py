"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

1. Equal vectors are one class, stood for by the smallest id.
2. Centroids are fitted on at most ``SAMPLE`` representatives (those of the smallest id hash) and every
   representative is assigned to the cell of its nearest centroid, its home. Cells are cut into blocks of at most
   ``BLOCK`` rows, written once.
3. Each pair of blocks meets once, where the angle between their middles is at most their radii and the angle of the
   threshold together. The pairs are a Cartesian product over the written blocks: tasks read them again and nothing is
   copied for each pair, so the disk needed grows with the table and not with the pairs.
4. In a pair only those rows count that may have a link into the other block. Without ``margin`` this uses two
   bounds that no link escapes: a vector's distance to the plane between the two centroids is at most that of linked
   vectors, and its angle to the other block's middle at most the block's radius plus the angle of the threshold. With
   ``margin`` rows count where their cosine to the other cell's centroid is at most that much below their home's, for one
   of the two: fewer products where vectors have little structure, at a recall to be measured (``recall`` does).
5. Products are first taken over few axes, those on which the sample spreads most, and the lengths of the two rests as
   one more: by Cauchy and Schwarz that is at least the cosine. What may reach the threshold is then taken whole, in double
   precision unless it is clear in single precision. A task emits counts and a spanning forest, never its pairs.

Vectors are scaled by a power of two to a largest component near 1, which changes no cosine, so squares of huge or tiny
components neither overflow nor vanish.

Defined results: null, empty and zero vectors, and those with null or non-finite components, link with nothing;
vectors of different lengths link with nothing; a null id takes part in nothing and gets 0 links, a null
component and kept; rows of one id each count as a vector of their own; other columns are left out and may have any
name; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .components import connected_components, forest
from .staging import Staging, bound_arrow_batches, trimmed

#: Fitted rows, homes a cell aimed at, cells at most, rows of a block, rows and columns of one product (a cache's worth).
SAMPLE, PER_CELL, MOST_CELLS, BLOCK, STRIP, TILE = 20_000, 8192, 512, 8192, 256, 512
#: Bytes of a block's vectors, of the blocks that a task keeps ready, and of a file of blocks.
BLOCK_BYTES, READY_BYTES, FILE_BYTES = 4 << 20, 48 << 20, 16 << 20


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; empty cells take the rows that fit worst."""
    if not len(x):
        return np.zeros((0, x.shape[1]))
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = x @ centroids.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        size = np.bincount(home, minlength=len(centroids))
        worst = np.argsort(near.max(axis=1))
        sums[size == 0] = x[worst[: (size == 0).sum()]]
        norm = np.linalg.norm(sums, axis=1)
        centroids = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centroids)
    return centroids


def front_axes(x: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal columns, those on which the unit rows spread most first; so many of them that the bound over them and the
    work on what it lets through cost least, by the pairs of some rows."""
    dim = x.shape[1]
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1] if dim <= 1024 else np.eye(dim)
    some = x[:1024] @ basis
    costs = {}
    for k in [*range(7, dim - 7, 8), dim]:
        front = with_rest(some[:, :k])
        costs[k] = k + 1 + 12_000 * float((front @ front.T >= least).mean() - 1 / max(1, len(some)))
    return basis[:, : min(costs, key=costs.get)]


def with_rest(front: np.ndarray) -> np.ndarray:
    """Projections of unit rows and, as one more column, the length of the rest."""
    return np.hstack([front, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", front, front)))[:, None]]).astype(np.float32)


def _vectors(column: pa.Array, kind: str) -> np.ndarray:
    """Binary vectors of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _packed(kind: str):
    """(rep, mult, h1, h2, dim, vec): the vector as bytes, times the power of two that brings its largest component to 0.5 to 1."""

    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            dims = pc.list_value_length(lists).to_numpy().astype(np.int64)
            if not len(dims):
                continue
            flat = lists.flatten().to_numpy().astype(kind)
            ends = np.cumsum(dims)
            power = np.frexp(np.maximum.reduceat(np.abs(flat), ends - dims))[1]
            flat = np.ldexp(flat, np.repeat(-power, dims)).astype(kind)
            places = np.concatenate([[0], ends]).astype(np.int32) * np.int32(flat.itemsize)
            vec = pa.Array.from_buffers(pa.binary(), len(dims), [None, pa.py_buffer(places), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(dims.astype(np.int32)), vec], names=["rep", "mult", "h1", "h2", "dim", "vec"])

    return run


def _by_dim(batch: pa.RecordBatch):
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims):
        yield int(dim), pa.Table.from_batches([batch]).filter(pa.array(dims == dim)).combine_chunks()


class Block:
    """A block ready for products: vectors in double precision are made of the rows that need it."""

    def __init__(self, cell: int, middle: np.ndarray, radius: float, reps: np.ndarray, mults: np.ndarray, raw: np.ndarray, axes: np.ndarray):
        self.cell, self.middle, self.radius, self.reps, self.mults, self.raw = cell, middle, radius, reps, mults, raw
        whole = raw.astype("<f8")
        self.norms = np.linalg.norm(whole, axis=1)
        whole /= self.norms[:, None]
        self.unit, self.front = whole.astype(np.float32), with_rest(whole @ axes)
        self.size = sum(x.nbytes for x in (self.raw, self.unit, self.front))

    def exact(self, other: Block, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Which of the row pairs reach the threshold, in double precision."""
        reach = np.zeros(len(i), dtype=bool)
        step = max(1, (8 << 20) // (8 * self.raw.shape[1]))
        for s in range(0, len(i), step):
            a, b = i[s : s + step], j[s : s + step]
            reach[s : s + step] = np.einsum("ij,ij->i", self.raw[a].astype("<f8"), other.raw[b].astype("<f8")) / (self.norms[a] * other.norms[b]) >= least
        return reach

    def links(self, other: Block, mine: np.ndarray, others: np.ndarray, least: float):
        """Row numbers of the linked pairs of the rows ``mine`` with the rows ``others``, in parts."""
        near, may, any_of = np.empty(STRIP * TILE, dtype=np.float32), np.empty(STRIP * TILE, dtype=bool), np.empty(STRIP * TILE // 8, dtype=bool)
        front, bound, held, waiting = self.front[mine], np.float32(least - 1e-4), [], 0
        for c in range(0, len(others), TILE):
            theirs = np.zeros((other.front.shape[1], TILE), dtype=np.float32)
            columns = others[c : c + TILE]
            theirs[:, : len(columns)] = other.front[columns].T
            for s in range(0, len(mine), STRIP):
                rows = mine[s : s + STRIP]
                n = len(rows) * TILE
                np.matmul(front[s : s + STRIP], theirs, out=near[:n].reshape(-1, TILE))
                np.greater_equal(near[:n], bound, out=may[:n])
                # few pairs pass, so they are looked for among eights
                eights = np.flatnonzero(np.not_equal(may[:n].view(np.uint64), 0, out=any_of[: n // 8]))
                if not len(eights):
                    continue
                e, place = np.nonzero(may[:n].reshape(-1, 8)[eights])
                i, j = np.divmod(eights[e] * 8 + place, TILE)
                if 32 * len(i) <= n:
                    true = j < len(columns)
                    held.append((rows[i[true]], columns[j[true]]))
                    waiting += len(i)
                    continue
                whole = (self.unit[rows] @ other.unit[columns].T).ravel()
                at = np.flatnonzero(whole >= bound)
                i, j, whole = rows[at // len(columns)], columns[at % len(columns)], whole[at]
                keep = whole >= least + 1e-4
                close = np.flatnonzero(~keep)
                keep[close] = self.exact(other, i[close], j[close], least)
                yield i[keep], j[keep]
            if waiting > 500_000 or (waiting and c + TILE >= len(others)):
                i, j = (np.concatenate(x) for x in zip(*held, strict=True))
                keep = self.exact(other, i, j, least)
                yield i[keep], j[keep]
                held, waiting = [], 0


def spanning(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, by id, of links between row i of the ids ``a`` and row j of ``b``: many links are first joined by one
    for each row, so few are left to be sorted."""
    if len(i) <= 4 * (len(a) + len(b)):
        return forest(a[i], b[j])
    across, over = np.full(len(a), -1), np.full(len(b), -1)
    across[i], over[j] = j, i
    some, met = np.flatnonzero(across >= 0), np.flatnonzero(over >= 0)
    u, w = forest(np.concatenate([a[some], a[over[met]]]), np.concatenate([b[across[some]], b[met]]))
    order = np.argsort(u)

    def root(ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(u[order], ids), len(u) - 1)
        return np.where(u[order][at] == ids, w[order][at], ids)

    x, y = root(a)[i], root(b)[j]
    apart = x != y
    return forest(np.concatenate([u, x[apart]]), np.concatenate([w, y[apart]])) if apart.any() else (u, w)


def near_vectors(rows: DataFrame, least: float = 0.9, margin: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    bound_arrow_batches(spark)
    staging = Staging(spark, "embeddings")
    kind, kept = ("<f4", "array<float>") if isinstance(rows.schema[vector_col].dataType.elementType, FloatType) else ("<f8", "array<double>")
    v = F.col("v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = v.isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kept).alias("v"))
    keyed = given.select("vec_id", F.when(usable, v).alias("v")).select("vec_id", "v", F.when(v.isNotNull(), F.xxhash64("v")).alias("h1"), F.when(v.isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"))

    def classes():
        once = keyed.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v"))
        return once.select("rep", "mult", "h1", "h2", "v").mapInArrow(trimmed(_packed(kind)), "rep long, mult long, h1 long, h2 long, dim int, vec binary")

    reps = staging.write(classes, "classes", moved_much=True)

    # per length: centroids and axes from a bounded sample
    sizes = {r[0]: r[1] for r in reps.groupBy("dim").count().collect()}
    centroids, axes = {}, {}
    for dim, n in sizes.items():
        sample = reps.where(F.col("dim") == dim).select("vec", F.xxhash64("rep").alias("key")).orderBy("key", "vec").limit(SAMPLE).collect()
        sample = unit(np.frombuffer(b"".join(bytes(r[0]) for r in sample), dtype=kind).reshape(-1, dim).astype("<f8"))
        centroids[dim], axes[dim] = spherical_k_means(sample, min(MOST_CELLS, -(-n // PER_CELL))), front_axes(sample, least)
    # a block of cells of one length follows the other
    first = dict(zip(centroids, np.cumsum([0, *(len(c) for c in centroids.values())]).tolist(), strict=False))
    held = spark.sparkContext.broadcast((centroids, first, axes))

    def homes(batch):
        centroids, first, _ = held.value
        for dim, part in _by_dim(batch):
            yield dim, part, (unit(_vectors(part["vec"], kind).astype("<f8")) @ centroids[dim].T).argmax(axis=1) + first[dim]

    def counted(batches):
        for batch in batches:
            for dim, _, home in homes(batch):
                cell, n = np.unique(home, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.full(len(cell), dim, dtype=np.int32)), pa.array(n)], names=["cell", "dim", "n"])

    width = int(kind[2:])
    rows_of = {dim: min(BLOCK, max(256, BLOCK_BYTES // (dim * width))) for dim in sizes}
    counts = reps.select("dim", "vec").mapInArrow(trimmed(counted), "cell int, dim int, n long").groupBy("cell", "dim").agg(F.sum("n")).collect()  # a row a cell
    parts = np.ones(sum(map(len, centroids.values())), dtype=np.int64)
    for cell, dim, n in counts:
        parts[cell] = 1 if n <= rows_of[dim] else -(-n * 9 // (8 * rows_of[dim]))
    dealt = spark.sparkContext.broadcast(parts)

    def seated(batches):
        for batch in batches:
            for _, part, home in homes(batch):
                rep = part["rep"].to_numpy()
                mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                salt = mixed % dealt.value[home].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(salt.astype(np.int32)), *(part[n].combine_chunks() for n in ("dim", "rep", "mult", "vec"))], names=["cell", "salt", "dim", "rep", "mult", "vec"])

    def blocks(batches):
        """Blocks of one cell and part, from rows in that order."""
        names = ["block", "cell", "dim", "middle", "radius", "reps", "mults", "vecs"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        key, n, made, pieces = None, 0, 0, []

        def block():
            cell, salt, dim = key
            vecs = b"".join(x for piece in pieces for x in piece[2])
            x = unit(np.frombuffer(vecs, dtype=kind).reshape(-1, dim).astype("<f8"))
            middle = x.sum(axis=0)
            middle = middle / norm if (norm := np.linalg.norm(middle)) > 1e-9 else x[0]
            radius = float(np.arccos(np.clip((x @ middle).min(), -1, 1)))
            row = (cell << 40 | salt << 16 | made, cell, dim, middle.tolist(), radius, *(np.concatenate([p[k] for p in pieces]).astype("<i8").tobytes() for k in (0, 1)), vecs)
            return pa.RecordBatch.from_arrays([pa.array([value], k) for value, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            cells, salts, dims, reps, mults = (batch.column(k).to_numpy() for k in range(5))
            vecs, at = batch.column(5), 0
            while at < len(cells):
                now = (int(cells[at]), int(salts[at]), int(dims[at]))
                if pieces and (now != key or n >= rows_of[key[2]]):
                    yield block()
                    made, n, pieces = (made + 1 if now == key else 0), 0, []
                key = now
                changed = np.flatnonzero((cells[at:] != now[0]) | (salts[at:] != now[1]))
                end = min(at + (int(changed[0]) if len(changed) else len(cells)), at + rows_of[now[2]] - n, len(cells))
                pieces.append((reps[at:end].copy(), mults[at:end].copy(), vecs[at:end].to_pylist()))
                n, at = n + end - at, end
        if pieces:
            yield block()

    files = max(math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)), -(-sum(n * (d * width + 16) for d, n in sizes.items()) // FILE_BYTES))
    schema = "block long, cell int, dim int, middle array<double>, radius double, reps binary, mults binary, vecs binary"

    def packed():
        seats = reps.select("dim", "rep", "mult", "vec").mapInArrow(trimmed(seated), "cell int, salt int, dim int, rep long, mult long, vec binary")
        return seats.repartition(files, "cell", "salt").sortWithinPartitions("cell", "salt", "rep").mapInArrow(trimmed(blocks), schema)

    packed = staging.write(packed, "blocks", moved_much=True)
    apart, turn = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-5, math.acos(least) + 1e-5
    a, b = (packed.select(*(F.col(c).alias(f"{side}_{c}") for c in packed.columns)) for side in "ab")
    meet = (F.col("a_dim") == F.col("b_dim")) & (F.col("a_block") <= F.col("b_block"))
    if margin is None:
        cosine = F.aggregate(F.zip_with("a_middle", "b_middle", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
        meet = meet & (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) <= F.col("a_radius") + F.col("b_radius") + turn)
    met = a.join(b.hint("shuffle_replicate_nl"), meet)

    def products(batches):
        centroids, first, axes = held.value
        ready: dict[int, Block] = {}
        links: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        trees = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]

        def side(batch, k, at):
            block, cell, dim, middle, radius, reps, mults, vecs = (batch.column(at + c)[k] for c in range(8))
            number, dim = block.as_py(), dim.as_py()
            if (held_block := ready.pop(number, None)) is None:
                reps, mults = (np.frombuffer(bytes(x.as_buffer()), dtype="<i8") for x in (reps, mults))
                raw = np.frombuffer(bytes(vecs.as_buffer()), dtype=kind).reshape(len(reps), -1)
                held_block = Block(cell.as_py() - first[dim], np.array(middle.as_py()), radius.as_py(), reps, mults, raw, axes[dim])
                while ready and sum(x.size for x in ready.values()) + held_block.size > READY_BYTES:
                    ready.pop(next(iter(ready)))
            ready[number] = held_block
            if number not in links:
                links[number] = (held_block.reps, np.zeros(len(held_block.reps), dtype=np.int64))
            return number, held_block, centroids[dim]

        def guests(x, other, c):
            """Which rows of x may have a link into the other block."""
            to = x.unit @ np.stack([c[x.cell], c[other.cell], other.middle]).T.astype(np.float32)
            if margin is not None:
                return to[:, 0] - to[:, 1] <= margin
            gap = math.sqrt(max(0.0, 2 - 2 * float(c[x.cell] @ c[other.cell]))) if x.cell != other.cell else 0.0
            return (to[:, 0] - to[:, 1] <= apart * gap + 1e-5) & (to[:, 2] >= math.cos(min(math.pi, other.radius + turn)) - 1e-5)

        for batch in batches:
            for k in range(batch.num_rows):
                (p, x, c), (q, y, _) = side(batch, k, 0), side(batch, k, 8)
                if p == q:
                    every = np.arange(len(x.reps))
                    takes = [(every, every)]
                else:
                    mine, others = guests(x, y, c), guests(y, x, c)
                    takes = [(mine, others)] if margin is None else [(mine | True, others), (mine, ~others)]
                    takes = [(np.flatnonzero(m), np.flatnonzero(o)) for m, o in takes]
                for mine, others in takes:
                    for i, j in x.links(y, mine, others, least) if len(mine) and len(others) else ():
                        if p == q:
                            i, j = i[i != j], j[i != j]
                        if not len(i):
                            continue
                        links[p][1][:] += np.bincount(i, weights=y.mults[j], minlength=len(x.reps)).astype(np.int64)
                        if p != q:
                            links[q][1][:] += np.bincount(j, weights=x.mults[i], minlength=len(y.reps)).astype(np.int64)
                        trees.append(spanning(i, j, x.reps, y.reps))
                        if sum(len(t[0]) for t in trees[1:]) > 100_000 + len(trees[0][0]):
                            trees = [forest(*(np.concatenate(t) for t in zip(*trees, strict=True)))]
        u, w = forest(*(np.concatenate(t) for t in zip(*trees, strict=True)))
        for ids, values, tree in [*((reps[n > 0], n[n > 0], False) for reps, n in links.values()), (u, w, True)]:
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(values), pa.array(np.full(len(ids), tree))], names=["a", "b", "is_link"])

    found = staging.write(met.mapInArrow(trimmed(products), "a long, b long, is_link boolean"), "found")
    counts = found.where("not is_link").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = connected_components(found.where("is_link").select("a", "b"), staging, "components")
    facts = reps.select("rep", "mult", "h1", "h2").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("root", "rep").alias("c"))
    staging.drop("blocks")
    joined = keyed.select("vec_id", "h1", "h2").join(facts, ["h1", "h2"], "left")
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def recall(found: DataFrame, rows: DataFrame, least: float = 0.9) -> float:
    """Found links over all links, by brute force on the driver: for small tables only."""
    by_length: dict[int, list] = {}
    for _, v in rows.select("vec_id", "embedding").collect():
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            by_length.setdefault(len(v), []).append(v)
    total = 0
    for held in by_length.values():
        x = unit(np.array(held, dtype=float))
        total += sum(int((x[k : k + 1024] @ x.T >= least).sum()) for k in range(0, len(x), 1024)) - len(x)
    return (found.groupBy().sum("n_links").first()[0] or 0) / total if total else 1.0
