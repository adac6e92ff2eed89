"""Connected components of links, distributed.

Each task first joins its own links by union-find and passes on a spanning forest. The forests are then
contracted by rounds of large and small stars: every node links its larger neighbours, then its smaller ones, to
the smallest node around it, until nothing changes. Minima are taken before anything is joined, so a node with
many links is summed up in every task, and its links stay split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it reaches) for the links a-b, by union-find
    in rounds: all links join the trees of their ends at once, then paths are halved until flat; nodes that are their own are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(root[x], root[y]):
            break
    below = root != np.arange(len(root))
    return nodes[below], nodes[root[below]]


def local_forest(links: DataFrame) -> DataFrame:
    """(u, v) with u > v: in each task a spanning forest of its links (two long columns)."""

    def run(batches):
        u, v = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            u, v = forest(np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()]))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame, staging: Staging, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b) but roots: the smallest node it reaches. A link with a null
    end is none."""
    edges = staging.write(local_forest(links.select("a", "b").where("a <> b")).distinct(), f"{name}-0")

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, k = state(edges), 0
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staging.write(large, f"{name}-{k}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()
        edges = staging.write(small, f"{name}-{k + 1}")
        staging.drop(f"{name}-{k}", f"{name}-{k}-large")
        after, k = state(edges), k + 1
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
