"""Connected components of an edge table, by alternating large and small stars; few edges are joined in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.plans.checkpoints import cut

ROUNDS = 60
FEW = 1 << 18  # edges that one task joins: 4 MB


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches: roots hook to smaller ones and pointers double until both rest."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        low, high = np.minimum(p, q), np.maximum(p, q)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if some:
        nodes, roots = joined(*(np.concatenate(x) for x in zip(*some, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of the edges (a, b), long; root is the component's smallest node.

    Up to ``few`` edges are joined in one task. With more, rounds follow the logarithm of a component's extent; each is
    written to the shared folder. Self-loops and repeated edges don't matter; without edges the result is empty.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    before = _state(edges)
    if before[0] <= few:
        return cut(edges.coalesce(1).mapInArrow(_in_one, "node long, root long"))
    for _ in range(ROUNDS):
        if not before[0]:
            break
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
