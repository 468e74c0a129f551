"""Connected components of cells and what follows from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.grid import around, cross, extent, idx, ring
from talus.plans.checkpoints import cut
from talus.plans.components import components as linked
from talus.plans.components import joined
from talus.plans.order import ordered


TILE = 256  # cells of a tile's side


def _in_tile(diagonal: bool, same: bool):
    """Cells of a tile (r, c, idx, same) with local, the first cell of their component inside the tile."""
    steps = ((0, 1), (1, 0), (1, 1), (1, -1)) if diagonal else ((0, 1), (1, 0))

    def run(_, table):
        r, c, idx = (table.column(x).to_numpy() for x in ("r", "c", "idx"))
        kind = np.unique(table.column("same").to_numpy(zero_copy_only=False), return_inverse=True)[1] if same else np.zeros(len(r), np.int64)
        r0, c0 = r - r.min() + 1, c - c.min() + 1
        at = np.full((r0.max() + 2, c0.max() + 2), -1)
        at[r0, c0] = np.arange(len(r))
        pairs = []
        for dr, dc in steps:
            other = at[r0 + dr, c0 + dc]
            tied = np.flatnonzero(other >= 0)
            tied = tied[kind[tied] == kind[other[tied]]]
            pairs.append((idx[tied], idx[other[tied]]))
        nodes, roots = joined(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        local = idx.copy()
        if len(nodes):
            place = np.minimum(np.searchsorted(nodes, idx), len(nodes) - 1)
            local = np.where(nodes[place] == idx, roots[place], idx)
        kept = ["r", "c", "idx", *(["same"] if same else [])]
        return table.select(kept).append_column("local", pa.array(local))

    return run


def components(df: DataFrame, mask: str = "mask", connectivity: int = 8, same: str | None = None, m: int | None = None) -> DataFrame:
    """(r, c, idx, root) of the set cells; root is the component's first cell in column-major order.

    same: a column that linked cells must share (components within equal labels). Tiles label their own cells; only
    components that touch along the rims of tiles are linked over the whole grid. m: the number of rows, if it is known
    (or more, for the same order); else df is read for it.
    """
    m = extent(df)[0] if m is None else m
    on = df.where(F.coalesce(F.col(mask), F.lit(False))).select("r", "c", idx(m).alias("idx"), *([F.col(same).cast("string").alias("same")] if same else []))
    tiles = on.withColumns({"_tr": F.floor(F.col("r") / TILE), "_tc": F.floor(F.col("c") / TILE)})
    own = "r int, c int, idx long, " + ("same string, " if same else "")
    cells = cut(tiles.groupBy("_tr", "_tc").applyInArrow(_in_tile(connectivity == 8, bool(same)), f"{own}local long"))
    edge = lambda x: (F.col(x) % TILE == 0) | (F.col(x) % TILE == TILE - 1)
    rim = cells.where(edge("r") | edge("c"))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if connectivity == 8 else [])]
    ahead = F.explode(F.array(*(F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in steps))).alias("to")
    keys = ["r", "c", *(["same"] if same else [])]
    near = rim.select(F.col("local").alias("a"), ahead, *(["same"] if same else [])).select("a", "to.r", "to.c", *(["same"] if same else []))
    met = near.join(rim.select(*keys, F.col("local").alias("b")), keys).where("a <> b").select("a", "b")
    roots = linked(met)
    return cells.join(roots.withColumnRenamed("node", "local"), "local", "left").select("r", "c", "idx", F.coalesce("root", "local").alias("root"))


def numbered(labelled: DataFrame, by: str = "root", name: str = "label") -> DataFrame:
    """Labels 1..K in the order of ``by``: places of the distinct labels, joined back."""
    ranks = ordered(labelled.select(by).distinct(), [F.col(by)], name).withColumn(name, (F.col(name) + 1).cast("int"))
    return labelled.join(ranks, by)


def sizes(labelled: DataFrame, by: str = "root") -> DataFrame:
    return labelled.groupBy(by).agg(F.count("*").alias("cells"))


def with_mask(df: DataFrame, kept: DataFrame, mask: str) -> DataFrame:
    """df with its mask set on the cells of ``kept`` only."""
    return df.drop(mask).join(kept.select("r", "c").withColumn("_kept", F.lit(True)), ["r", "c"], "left").withColumn(mask, F.col("_kept").isNotNull()).drop("_kept")


def area_open(df: DataFrame, least: int, mask: str = "mask") -> DataFrame:
    """df without components of fewer than ``least`` cells."""
    found = cut(components(df, mask))
    return with_mask(df, found.join(sizes(found).where(F.col("cells") >= least), "root"), mask)


def clear_border(df: DataFrame, mask: str = "mask") -> DataFrame:
    """df without components that touch the grid's edge."""
    found = cut(components(df, mask))
    return with_mask(df, found.join(found.where(ring(*extent(df))).select("root").distinct(), "root", "left_anti"), mask)


def regional_minima(df: DataFrame, z: str = "z") -> DataFrame:
    """df with minimum: the cell's plateau (8-connected, equal z) has no lower neighbour."""
    m, _ = extent(df)
    marked = df.withColumns({"_has": F.col(z).isNotNull(), "_z": F.col(z)})
    found = cut(components(marked, "_has", same="_z"))
    low = around(df.select("r", "c", z), z)
    lower = low.where(F.least(*(F.col(f"{z}_{s}") for s in ("nw", "n", "ne", "w", "e", "sw", "s", "se"))) < F.col(z)).select("r", "c")
    bad = found.join(lower, ["r", "c"], "left_semi").select("root").distinct()
    return with_mask(df.withColumn("minimum", F.lit(False)), found.join(bad, "root", "left_anti"), "minimum")


def expand_labels(df: DataFrame, distance: int, label: str = "label", into: str = "room") -> DataFrame:
    """df with label also on cells of ``into`` within ``distance``: of the nearest labelled cell, ties to the smallest label."""
    offsets = [(a, b, a * a + b * b) for a in range(-distance, distance + 1) for b in range(-distance, distance + 1) if 0 < a * a + b * b <= distance * distance]
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d).alias("d")) for a, b, d in offsets))).alias("o")
    seeds = df.where(F.col(label) > 0).select("r", "c", label, near).select((F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"), F.struct(F.col("o.d").alias("d"), F.col(label).alias("l")).alias("x"))
    best = seeds.groupBy("r", "c").agg(F.min("x").alias("x"))
    return df.join(best, ["r", "c"], "left").withColumn(label, F.when(F.col(label) > 0, F.col(label)).when(F.col(into), F.coalesce("x.l", F.lit(0))).otherwise(0).cast("long")).drop("x")


def fill_labels(df: DataFrame, label: str = "label", into: str = "room", first: int = 2) -> DataFrame:
    """df with label on all cells of ``into``: of the nearest labelled cell however far, ties to the smallest label.

    Distances double until no such cell is left without a label, each time only for those cells: a cell's ring is
    searched tile by tile. Without any label nothing changes.
    """
    seeds = cut(df.where(F.col(label) > 0).select("r", "c", F.col(label).cast("long").alias("l")))
    open_ = cut(df.where(F.col(into) & (F.coalesce(F.col(label), F.lit(0)) <= 0)).select("r", "c"))
    if not seeds.limit(1).count():
        return df
    found, reach = None, first
    rim = cut(rim_of(seeds))  # no cell inside a label is nearer than its rim
    while open_.limit(1).count():
        tile = lambda x, d=0: F.floor((F.col(x) + d) / reach)  # noqa: B023, E731
        spread = F.array(*(F.lit(k) for k in (-1, 0, 1)))
        wide = open_.withColumns({"tr": tile("r"), "tc": tile("c")}).withColumn("dr", F.explode(spread)).withColumn("dc", F.explode(spread))
        wide = wide.select("r", "c", (F.col("tr") + F.col("dr")).alias("tr"), (F.col("tc") + F.col("dc")).alias("tc"))
        near = rim.select(F.col("r").alias("sr"), F.col("c").alias("sc"), "l", tile("r").alias("tr"), tile("c").alias("tc"))
        d = (F.col("r") - F.col("sr")) * (F.col("r") - F.col("sr")) + (F.col("c") - F.col("sc")) * (F.col("c") - F.col("sc"))
        best = wide.join(near, ["tr", "tc"]).where(d <= reach * reach).groupBy("r", "c").agg(F.min(F.struct(d.alias("d"), "l")).alias("x"))
        best = cut(best.select("r", "c", F.col("x.l").alias("_near")))
        found = best if found is None else found.unionAll(best)
        open_ = cut(open_.join(best, ["r", "c"], "left_anti"))
        reach *= 2
    if found is None:
        return df
    return df.join(found, ["r", "c"], "left").withColumn(label, F.coalesce("_near", F.col(label)).cast("long")).drop("_near")


def rim_of(seeds: DataFrame, label: str = "l") -> DataFrame:
    """Labelled cells (r, c, label) that have a neighbour in a row or column without that label."""
    near = cross(seeds, label)
    inner = F.lit(True)
    for s in ("n", "s", "w", "e"):
        inner = inner & F.col(f"{label}_{s}").eqNullSafe(F.col(label))
    return near.where(~inner).select("r", "c", label)


def spur_score(labelled: DataFrame, by: str = "root") -> DataFrame:
    """(by, spur 0-6) in column-major order: one column, one row, and row or column steps all 1 or all -1."""
    w = Window.partitionBy(by).orderBy("idx")
    steps = labelled.withColumns({"_dr": F.col("r") - F.lag("r").over(w), "_dc": F.col("c") - F.lag("c").over(w)})
    every = lambda x: F.coalesce(F.bool_and(x), F.lit(True)).cast("int")
    tests: list[Column] = [(F.min("c") == F.max("c")).cast("int"), (F.min("r") == F.max("r")).cast("int")]
    tests += [every(F.col(d) == s) for d in ("_dr", "_dc") for s in (1, -1)]
    return steps.groupBy(by).agg(F.count("*").alias("cells"), sum(tests, F.lit(0)).cast("int").alias("spur"))


def continuous(labelled: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, whole): whether a cluster's cells, labelled by ``root``, are one component."""
    return labelled.groupBy(cluster).agg((F.countDistinct("root") == 1).alias("whole"))
