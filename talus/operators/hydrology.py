"""Depressions, flats, flow directions and accumulation.

Depressions fill to their spill level by relaxation on tiles. Ties of flow direction follow the
order (elevation, cost in flats, column-major place): it is compared between neighbours as a
struct, so that no global sort is needed. Accumulation adds up inside tiles and links only the cells where flow leaves one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators.focal import label_boundary
from talus.operators.grid import SIDES, around, extent, idx, ring, sides
from talus.operators.labels import clear_border, components, expand_labels, numbered, regional_minima, sizes
from talus.operators.morphology import chain, thinned
from talus.plans.checkpoints import cut
from talus.plans.order import ordered
from talus.plans.tiles import fixpoint, tiled

_INF = float("inf")


def _neighbour_min(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, 1, constant_values=np.inf)
    m, n = x.shape
    return np.min([p[1 + a : 1 + a + m, 1 + b : 1 + b + n] for a, b in SIDES.values()], axis=0)


def fill_depressions(df: DataFrame, z: str = "z") -> DataFrame:
    """df with filled: the lowest level at which a cell spills to the grid's edge or to a cell without data (8-connected)."""
    m, n = extent(df)
    near = around(df.withColumn("_z", F.col(z)), "_z")
    gap = sum((F.col(f"_z_{s}").isNull().cast("int") for s in SIDES), F.lit(0)) > 0
    start = near.select("r", "c", F.col(z).alias("_z"), F.when(F.col(z).isNull(), None).when(ring(m, n) | gap, F.col(z)).otherwise(_INF).alias("filled"))

    def kernel(grid: dict, place: dict) -> dict:
        z_, now = grid["_z"], np.where(np.isnan(grid["filled"]), np.inf, grid["filled"])
        while True:
            new = np.minimum(now, np.maximum(z_, _neighbour_min(now)))
            new = np.where(np.isnan(z_), np.inf, new)
            if (new == now).all():
                return {"_new": np.where(np.isnan(z_), np.nan, now)}
            now = new

    return df.join(fixpoint(start, ["_z"], "filled", kernel).select("r", "c", "filled"), ["r", "c"])


def flats_and_sills(df: DataFrame, z: str = "filled") -> DataFrame:
    """df with flat (no lower neighbour, neither on the edge nor beside no data) and sill (not flat, at the level of the highest flat beside)."""
    m, n = extent(df)
    near = around(df, z)
    whole = sum((F.col(f"{z}_{s}").isNull().cast("int") for s in SIDES), F.lit(0)) == 0
    flat = F.coalesce(F.col(z).isNotNull() & ~ring(m, n) & whole & (F.least(*sides(z)) >= F.col(z)), F.lit(False))
    marked = near.select(*df.columns, flat.alias("flat")).withColumn("_level", F.when(F.col("flat"), F.col(z)))
    high = F.greatest(F.col("_level"), *sides("_level"))
    return around(marked, "_level").select(*df.columns, "flat", F.coalesce(~F.col("flat") & (high == F.col(z)), F.lit(False)).alias("sill"))


def closed_minima(df: DataFrame, z: str = "filled") -> DataFrame:
    """df with closed: regional minima that do not touch the grid's edge."""
    low = regional_minima(df, z)
    return clear_border(low, "minimum").withColumnRenamed("minimum", "closed")


def carve_cost(df: DataFrame, z: str = "z", filled: str = "filled", weight: float = 2.0) -> DataFrame:
    """df (with flat) with cost: in each flat component (greatest depth - depth) ^ weight + 0.1; elsewhere the depth."""
    found = components(df, "flat").select("r", "c", "root")
    deep = df.join(found, ["r", "c"], "left").withColumn("_depth", F.coalesce(F.col(filled) - F.col(z), F.lit(0.0)))
    most = deep.where("root is not null").groupBy("root").agg(F.max("_depth").alias("_most"))
    cost = F.when(F.col("_most").isNotNull(), F.pow(F.col("_most") - F.col("_depth"), F.lit(weight)) + 0.1).otherwise(F.col("_depth"))
    return deep.join(most, "root", "left").select(*df.columns, cost.alias("cost"))


def presills(df: DataFrame, z: str = "filled") -> DataFrame:
    """df (with flat and sill) with presill: flat cells beside a sill of their level."""
    near = around(df.withColumn("_level", F.when(F.col("sill"), F.col(z))), "_level")
    at_level = sum((F.coalesce((F.col(f"_level_{s}") == F.col(z)).cast("int"), F.lit(0)) for s in SIDES), F.lit(0)) > 0
    return near.select(*df.columns, (F.col("flat") & at_level).alias("presill"))


def flat_distance(df: DataFrame) -> DataFrame:
    """df (flat, presill, cost) with aux: 1 + the cheapest way from a presill through flats; null on other cells."""
    start = df.select("r", "c", F.when(F.col("flat"), F.col("cost")).alias("_cost"), F.when(F.col("flat"), F.when(F.col("presill"), 0.0).otherwise(_INF)).alias("_way"))

    def kernel(grid: dict, place: dict) -> dict:
        cost = np.where(np.isnan(grid["_cost"]), np.inf, grid["_cost"])
        now = np.where(np.isnan(grid["_way"]), np.inf, grid["_way"])
        m, n = now.shape
        pc = np.pad(cost, 1, constant_values=np.inf)
        while True:
            p, new = np.pad(now, 1, constant_values=np.inf), now
            for a, b in SIDES.values():
                w = math.sqrt(2.0) if a and b else 1.0
                new = np.minimum(new, p[1 + a : 1 + a + m, 1 + b : 1 + b + n] + w * 0.5 * (cost + pc[1 + a : 1 + a + m, 1 + b : 1 + b + n]))
            if (new == now).all():
                return {"_new": np.where(np.isnan(grid["_way"]), np.nan, now)}
            now = new

    way = fixpoint(start, ["_cost"], "_way", kernel).select("r", "c", (F.col("_way") + 1).alias("aux"))
    return df.join(way, ["r", "c"])


def edge_distance(df: DataFrame, cellsize: float) -> DataFrame:
    """df (with flat) with cost: Euclidean distance of flat cells to the nearest other cell; halos double until they hold it."""
    halo = 16
    while True:

        def kernel(grid: dict, place: dict, halo: int = halo) -> dict:
            inside = np.nan_to_num(grid["flat"]) > 0
            far = 4.0 * halo
            down = np.where(inside, far, 0.0)
            for i in range(1, len(down)):
                down[i] = np.minimum(down[i], down[i - 1] + 1)
            for i in range(len(down) - 2, -1, -1):
                down[i] = np.minimum(down[i], down[i + 1] + 1)
            best = down**2
            for k in range(1, halo + 1):
                best[:, k:] = np.minimum(best[:, k:], down[:, :-k] ** 2 + k * k)
                best[:, :-k] = np.minimum(best[:, :-k], down[:, k:] ** 2 + k * k)
            return {"cost": np.sqrt(best)}

        found = cut(tiled(df, ["flat"], kernel, "cost double", halo))
        if (found.agg(F.max("cost")).first()[0] or 0) <= halo:
            return df.join(found.withColumn("cost", F.col("cost") * cellsize), ["r", "c"])
        halo *= 2


def receivers(df: DataFrame, cellsize: float = 10.0, z: str = "filled") -> DataFrame:
    """df (with aux, null outside flats) with idx and recv: of the last in order among the cell and its 4 neighbours, and
    likewise with the diagonal ones, the diagonal one where it is as steep and later in order. No receiver: null."""
    m, _ = extent(df)
    order = F.struct(F.coalesce(z, F.lit(-_INF)).alias("z"), F.coalesce("aux", F.lit(-_INF)).alias("a"), (-F.col("idx")).alias("i"))
    near = around(df.withColumn("idx", idx(m)).withColumn("_k", order), "_k")
    last = lambda names: F.least(F.col("_k"), *(F.col(f"_k_{s}") for s in names))
    near = near.withColumns({"_card": last(("n", "s", "w", "e")), "_diag": last(("nw", "ne", "sw", "se"))})

    def drop(k: str, step: float):
        lower = F.when(F.col(f"{k}.z") > -_INF, (F.col("_k.z") - F.col(f"{k}.z")) / step)
        return F.when(F.col(f"{k}.i") == F.col("_k.i"), -_INF).otherwise(lower)

    steeper = F.coalesce(drop("_card", cellsize) <= drop("_diag", cellsize * math.sqrt(2.0)), F.lit(False)) & (F.col("_diag") < F.col("_card"))
    to = F.when(steeper, F.col("_diag")).otherwise(F.col("_card"))
    return near.withColumn("_to", to).select(
        *df.columns, "idx", F.when(F.col(z).isNotNull() & (F.col("_to.z") > -_INF) & (F.col("_to.i") != F.col("_k.i")), -F.col("_to.i")).alias("recv")
    )


def flow_direction(df: DataFrame, cellsize: float = 10.0, preprocess: str = "carve", weight: float = 2.0, inverse: bool = False) -> DataFrame:
    """(r, c, filled, idx, recv) of a grid with z."""
    if preprocess not in ("carve", "fill", "none"):
        raise ValueError(f"unknown preprocess: {preprocess!r}")
    grid = df.select("r", "c", "z")
    if inverse:
        low, high = grid.agg(F.min("z"), F.max("z")).first()
        grid = grid.withColumn("z", F.lit(high) + F.lit(low) - F.col("z"))
    grid = grid.withColumn("filled", F.col("z")) if preprocess == "none" else fill_depressions(grid)
    grid = cut(presills(flats_and_sills(grid)))
    grid = carve_cost(grid, weight=weight) if preprocess == "carve" else edge_distance(grid, cellsize)
    return cut(receivers(flat_distance(cut(grid)), cellsize).select("r", "c", "filled", "idx", "recv"))


TILE, FEW = 256, 1 << 18  # cells of a tile's side; rim cells that one task adds up


def routed(to: np.ndarray, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What flows through each cell, and the last cell of its way; to: place of the receiver or -1. Pointers double."""
    acc, last, to = acc.copy(), np.arange(len(to)), to.copy()
    while (to >= 0).any():
        on = to >= 0
        last[on] = last[to[on]]
        acc += np.bincount(to[on], acc[on], len(acc))
        to[on] = to[to[on]]
    return acc, last


def _places(idx: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in the sorted idx, -1 where it is not there."""
    at = np.minimum(np.searchsorted(idx, wanted), max(len(idx) - 1, 0))
    return np.where(idx[at] == wanted, at, -1) if len(idx) else np.full(len(wanted), -1)


def _tile(table: pa.Table) -> tuple[np.ndarray, ...]:
    """idx, recv (0 for none), own weight and place of the receiver, in order of idx."""
    idx, recv, own = (table.column(x).to_numpy() for x in ("idx", "recv", "own"))
    order = np.argsort(idx)
    idx, recv, own = idx[order], np.nan_to_num(recv.astype(float)).astype(np.int64)[order], own[order]
    return idx, recv, own, np.where(recv > 0, _places(idx, recv), -1)


def _rims(_, table):
    """Of each cell whose way leaves the tile, and of each on its rim: receiver outside, flow of this tile, last cell of the way if it leaves from there."""
    idx, recv, own, to = _tile(table)
    acc, last = routed(to, own)
    leaves = (recv > 0) & (to < 0)
    r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
    rim = np.isin(idx, table.column("idx").to_numpy()[(r % TILE == 0) | (r % TILE == TILE - 1) | (c % TILE == 0) | (c % TILE == TILE - 1)]) | leaves
    ends = leaves[last]
    return pa.table({"idx": pa.array(idx[rim]), "out": pa.array(recv[rim], mask=~leaves[rim]), "acc": pa.array(acc[rim]), "last": pa.array(idx[last][rim], mask=~ends[rim])})


def _tile_sums(_, table):
    idx, _, own, to = _tile(table)
    return pa.table({"idx": pa.array(idx), "acc": pa.array(routed(to, own)[0])})


def _sums_in_one(batches):
    some = [[b.column(x).to_numpy(zero_copy_only=False) for x in ("idx", "to", "acc")] for b in batches]
    if some:
        idx, to, acc = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.argsort(idx)
        idx, to, acc = idx[order], np.nan_to_num(to.astype(float)).astype(np.int64)[order], acc[order]
        yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(routed(np.where(to > 0, _places(idx, to), -1), acc)[0])], names=["idx", "acc"])


def _sums(links: DataFrame, few: int) -> DataFrame:
    """(idx, acc) of (idx, to, acc): what flows through. Few rows are added up in one task; else pointers double until all have ended."""
    now = cut(links)
    if now.limit(few + 1).count() <= few:
        return now.coalesce(1).mapInArrow(_sums_in_one, "idx long, acc double")
    while now.where("to is not null").limit(1).count():
        given = now.where("to is not null").groupBy(F.col("to").alias("idx")).agg(F.sum("acc").alias("_more"))
        next_to = now.select(F.col("idx").alias("to"), F.col("to").alias("_next"))
        moved = now.join(next_to, "to", "left").select("idx", F.col("_next").alias("to"), "acc")
        now = cut(moved.join(given, "idx", "left").select("idx", "to", (F.col("acc") + F.coalesce("_more", F.lit(0.0))).alias("acc")))
    return now.select("idx", "acc")


def flow_accumulation(flow: DataFrame, weight: str | None = None, few: int = FEW) -> DataFrame:
    """flow (r, c, idx, recv) with acc: what flows through a cell, its own weight (1) included.

    Tiles add up their own cells; only cells where flow leaves a tile are linked over the whole grid; what comes in is
    then added along the ways inside each tile.
    """
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = flow.select("r", "c", "idx", "recv", own.alias("own"), F.floor(F.col("r") / TILE).alias("_tr"), F.floor(F.col("c") / TILE).alias("_tc"))
    rims = cut(cells.groupBy("_tr", "_tc").applyInArrow(_rims, "idx long, out long, acc double, last long"))
    leaving = rims.where("out is not null").select("idx", "out", "acc")
    links = leaving.join(rims.select(F.col("idx").alias("out"), F.col("last").alias("to")), "out", "left").select("idx", "to", "acc")
    through = _sums(links, few)
    inflow = leaving.select("idx", "out").join(through, "idx").groupBy(F.col("out").alias("idx")).agg(F.sum("acc").alias("_in"))
    fed = cells.join(inflow, "idx", "left").withColumn("own", F.col("own") + F.coalesce("_in", F.lit(0.0))).drop("_in")
    return flow.join(fed.groupBy("_tr", "_tc").applyInArrow(_tile_sums, "idx long, acc double"), "idx")


def ridges_and_valleys(df: DataFrame, cellsize: float = 10.0, ridge: float = 5.0, valley: float = 100.0) -> DataFrame:
    """(r, c, ridge, valley, nogrow): accumulation above the thresholds, of the upside-down grid for ridges; thinned together."""
    def above(inverse: bool, least: float, name: str) -> DataFrame:
        acc = flow_accumulation(flow_direction(df, cellsize, inverse=inverse))
        return chain(acc.select("r", "c", (F.col("acc") > least).alias("mask")), [("diag", 1)]).withColumnRenamed("mask", name)

    both = cut(above(True, ridge, "ridge").join(above(False, valley, "valley"), ["r", "c"]))
    lines = thinned(both.select("r", "c", (F.col("ridge") | F.col("valley")).alias("mask")))
    return both.join(lines.withColumnRenamed("mask", "nogrow"), ["r", "c"])


def nogrow_from_units(df: DataFrame) -> DataFrame:
    """(r, c, nogrow) of a grid with z and unit: borders of units on cells with data and a unit, thinned."""
    edges = label_boundary(df, "unit").select("r", "c", (F.col("edge") & F.col("z").isNotNull() & (F.col("unit") > 0)).alias("mask"))
    return thinned(edges).withColumnRenamed("mask", "nogrow")


def reconstruct_units(df: DataFrame, fill: int = 2, least: int = 4) -> DataFrame:
    """df (ridge, valley, valid) with unit: 4-connected parts between the lines, specks dropped, grown into ridges, renumbered 1..K."""
    found = cut(components(df.withColumn("_open", F.col("valid") & ~(F.col("ridge") | F.col("valley"))), "_open", 4))
    kept = found.join(sizes(found).where(F.col("cells") >= least).select("root"), "root", "left_semi")
    first = kept.groupBy("root").agg(F.min(F.struct("r", "c")).alias("first"))  # numbered row by row
    named = numbered(kept.join(first, "root"), "first", "unit").select("r", "c", F.col("unit").cast("long"))
    grid = df.drop("unit").join(named, ["r", "c"], "left").withColumn("unit", F.coalesce("unit", F.lit(0).cast("long")))
    if fill:
        grid = expand_labels(grid.withColumn("_room", F.col("valid") & ~F.col("valley") & (F.col("unit") == 0)), fill, "unit", "_room").drop("_room")
    return grid


def upstream_order(df: DataFrame, z: str = "filled") -> DataFrame:
    """df (idx, aux) with rank (from 1), from the highest, in flats from the farthest, then in column-major order. receivers() does not need it."""
    low = lambda x: F.coalesce(F.col(x), F.lit(-_INF)).desc()
    return ordered(df, [low(z), low("aux"), F.col("idx")], "rank").withColumn("rank", F.col("rank") + 1)
