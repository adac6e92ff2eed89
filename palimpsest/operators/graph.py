"""Closures, histories and common ancestors of commit graphs.

Edges are rows (child, parent, pos): ``pos`` is the parent's place among its child's parents. Many walks run at once,
told apart by ``seed``; (depth, rank) sorts a walk's nodes in breadth-first order, and a node is found where that
order meets it first. All starts of a seed have the empty rank.

A commit graph is small beside what its commits hold. Up to ``HELD_EDGES`` edges, which are counted first, the graph
is broadcast as arrays and every task walks its seeds alone, without a job a level. Beyond that, walks go
level by level: a join and an anti-join each, checkpointed, so lineage stays short and a lost executor costs one
level; ranks then spell the places of the parents taken and grow with the depth.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Edges of a graph that is broadcast: some 100 MB in a worker.
HELD_EDGES = 1_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, without lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def parent_edges(commits: DataFrame) -> DataFrame:
    """child, parent, pos of commits (commit_id, parent_ids)."""
    return commits.select(F.col("commit_id").alias("child"), F.posexplode("parent_ids").alias("pos", "parent")).where("parent is not null and parent <> ''")


class HeldGraph:
    """A graph as lists: the parents of node number i, in order, are ``parents[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, child: list, parent: list, pos: list):
        self.names = list(dict.fromkeys([*child, *parent]))
        self.number = {name: i for i, name in enumerate(self.names)}
        of = np.fromiter((self.number[c] for c in child), dtype=np.int64, count=len(child))
        order = np.lexsort((np.asarray(pos, dtype=np.int64), of))
        self.parents = np.fromiter((self.number[p] for p in parent), dtype=np.int64, count=len(parent))[order].tolist()
        self.bounds = np.searchsorted(of[order], np.arange(len(self.names) + 1)).tolist()

    def above(self, i: int) -> list[int]:
        return self.parents[self.bounds[i] : self.bounds[i + 1]]

    def levels(self, starts: list[int]) -> Iterator[list[int]]:
        """Nodes by depth, each level in breadth-first order."""
        seen, level = set(starts), list(starts)
        while level:
            yield level
            ahead = []
            for i in level:
                for p in self.above(i):
                    if p not in seen:
                        seen.add(p)
                        ahead.append(p)
            level = ahead

    def heights(self) -> list[int]:
        """Each node's longest way up; a child is higher than its parents."""
        children: list[list[int]] = [[] for _ in self.names]
        missing = [self.bounds[i + 1] - self.bounds[i] for i in range(len(self.names))]
        for i in range(len(self.names)):
            for p in self.above(i):
                children[p].append(i)
        height, ready = [0] * len(self.names), [i for i, n in enumerate(missing) if not n]
        for i in ready:
            for c in children[i]:
                height[c] = max(height[c], height[i] + 1)
                missing[c] -= 1
                if not missing[c]:
                    ready.append(c)
        if len(ready) < len(self.names):
            raise ValueError("the graph has a cycle")
        return height


def held(edges: DataFrame) -> HeldGraph | None:
    """The graph on the driver, if it has at most ``HELD_EDGES`` edges."""
    rows = edges.select("child", "parent", "pos").where("child is not null and parent is not null")
    if rows.limit(HELD_EDGES + 1).count() > HELD_EDGES:
        return None
    table = rows.toArrow()
    return HeldGraph(*(table.column(c).to_pylist() for c in ("child", "parent", "pos")))


def walk(seeds: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """seed, node, depth, rank for everything reachable from (seed, node), itself at depth 0.

    ``nodes`` (column node) limits the walk to known nodes; without it, parents that have no row of their own
    count as found.
    """
    if nodes is not None:
        edges = edges.join(nodes.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent", "pos")
    graph = held(edges)
    return _level_walk(seeds, edges) if graph is None else _held_walk(seeds, edges, graph)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _held_walk(seeds: DataFrame, edges: DataFrame, graph: HeldGraph) -> DataFrame:
    shared = seeds.sparkSession.sparkContext.broadcast(graph)  # at most HELD_EDGES edges
    starts = seeds.select("seed", "node").distinct()
    children = edges.select(F.col("child").alias("node")).distinct()
    alone = starts.withColumn("depth", F.lit(0).cast("long")).withColumn("rank", F.lit(""))
    # starts with parents are nodes of the graph, so a seed has a bounded number of them
    walked = starts.join(children, "node", "left_semi").groupBy("seed").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    kinds = (_arrow(seeds, "seed"), _arrow(seeds, "node"), pa.int64(), pa.string())

    def run(batches):
        graph = shared.value
        for batch in batches:
            for seed, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for depth, level in enumerate(graph.levels([graph.number[n] for n in nodes])):
                    if depth:
                        n = len(level)
                        columns = ([seed] * n, [graph.names[i] for i in level], [depth] * n, [f"{k:012d}" for k in range(n)])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["seed", "node", "depth", "rank"])

    found = walked.mapInArrow(run, alone.schema)
    # a start that another start reaches has been found at depth 0
    return alone.unionAll(found.join(starts, ["seed", "node"], "left_anti").select("seed", "node", "depth", "rank"))


def _level_walk(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    step = edges.select(F.col("child").alias("node"), F.col("parent").alias("next"), F.lpad(F.col("pos").cast("string"), 6, "0").alias("place"))
    frontier = checkpointed(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0).cast("long")).withColumn("rank", F.lit("")))
    found = frontier
    while not frontier.isEmpty():
        ahead = frontier.join(step, "node").select("seed", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("rank", "place").alias("rank"))
        ahead = ahead.join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = checkpointed(ahead.groupBy("seed", "node").agg(F.min("depth").alias("depth"), F.min("rank").alias("rank")))
        found = found.unionAll(frontier)
    return found


def history(start: DataFrame, edges: DataFrame) -> DataFrame:
    """node, depth, rank of one walk from the rows (node) of ``start``; order by depth and rank."""
    return walk(start.select(F.lit(0).alias("seed"), "node"), edges).drop("seed")


def common_ancestors(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pair, a, b, ancestor: of a's ancestors (itself included) the one that a breadth-first walk from b meets first;
    null if there is none. ``pair`` is unique."""
    pairs = pairs.select("pair", "a", "b")
    graph = held(edges)
    if graph is not None:
        return _held_ancestors(pairs, graph)
    # one walk serves both sides, and pairs that share a side
    ends = pairs.select(F.col("a").alias("seed")).unionAll(pairs.select(F.col("b").alias("seed"))).where("seed is not null").distinct()
    reached = _level_walk(ends.withColumn("node", F.col("seed")), edges)
    from_a = pairs.join(reached, F.col("a") == F.col("seed")).select("pair", "node")
    from_b = pairs.join(reached, F.col("b") == F.col("seed")).select("pair", "node", "depth", "rank")
    met = from_b.join(from_a, ["pair", "node"]).groupBy("pair").agg(F.min_by("node", F.struct("depth", "rank")).alias("ancestor"))
    return pairs.join(met, "pair", "left")


def first_common(graph: HeldGraph, height: list[int], a, b):
    """The first of b's ancestors, in breadth-first order, that is an ancestor of a.

    A's ancestors are taken from the highest down, and only as far as the node in question is high: ends that lie close
    together need not walk the whole history.
    """
    if a is None or b is None or a == b:
        return a if a == b else None
    if a not in graph.number or b not in graph.number:
        return None
    first = graph.number[a]
    seen, heap = {first}, [(-height[first], first)]
    for level in graph.levels([graph.number[b]]):
        for node in level:
            while heap and -heap[0][0] > height[node]:
                for p in graph.above(heapq.heappop(heap)[1]):
                    if p not in seen:
                        seen.add(p)
                        heapq.heappush(heap, (-height[p], p))
            if node in seen:
                return graph.names[node]
    return None


def _held_ancestors(pairs: DataFrame, graph: HeldGraph) -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast((graph, graph.heights()))  # at most HELD_EDGES edges
    kind = _arrow(pairs, "a")

    def run(batches):
        graph, height = shared.value
        for batch in batches:
            met = [first_common(graph, height, a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(met, kind)], names=["pair", "a", "b", "ancestor"])

    out = pairs.withColumn("ancestor", F.col("a"))
    return pairs.mapInArrow(run, out.schema)
