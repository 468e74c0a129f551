"""Kernels on tiles with halos, and fix-points over them.

A tile is a square of cells with ``halo`` more on each side. An operation of radius k a step can
take halo / k steps in one exchange, so chains of stencil passes need one shuffle instead of one for
each pass. A tile's cells are bounded by its size, whatever the grid.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.plans.checkpoints import cut

SIZE, ROUNDS = 256, 10_000
Kernel = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], dict[str, np.ndarray]]


def tiled(df: DataFrame, attributes: list[str], kernel: Kernel, out: str, halo: int, size: int = SIZE) -> DataFrame:
    """(r, c, columns of ``out``) for the cells of df.

    kernel gets 2-D arrays of the attributes (float64, NaN for null or outside) and ``place``: r, c and
    ``inside`` (whether df has the cell); it returns arrays for ``out`` of the same shape.
    """
    size = max(size, halo)
    near = lambda x: F.array_distinct(F.transform(F.array(F.lit(-halo), F.lit(0), F.lit(halo)), lambda d: F.floor((F.col(x) + d) / size).cast("int")))
    cells = df.select("r", "c", *[F.col(a).cast("double").alias(a) for a in attributes])
    spread = cells.withColumn("_tr", F.explode(near("r"))).withColumn("_tc", F.explode(near("c"))).where("_tr >= 0 and _tc >= 0")
    names = [x.split()[0] for x in out.split(", ")]
    types = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in out.split(", ")]

    def run(key, table):  # no type hints: they would choose another form of call
        tr, tc = (k.as_py() for k in key)
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        r0, c0 = tr * size - halo, tc * size - halo
        shape = (size + 2 * halo, size + 2 * halo)
        grid = {}
        at = (r - r0, c - c0)
        for a in attributes:
            grid[a] = np.full(shape, np.nan)
            grid[a][at] = table.column(a).to_numpy()
        inside = np.zeros(shape, bool)
        inside[at] = True
        rows, columns = np.mgrid[r0 : r0 + shape[0], c0 : c0 + shape[1]]
        made = kernel(grid, {"r": rows, "c": columns, "inside": inside})
        core = (r >= tr * size) & (r < (tr + 1) * size) & (c >= tc * size) & (c < (tc + 1) * size)
        at = (at[0][core], at[1][core])
        columns_out = []
        for x, kind in zip(names, kinds, strict=True):
            v = made[x][at]
            columns_out.append(pa.array(v, mask=np.isnan(v), type=kind) if v.dtype.kind == "f" else pa.array(v).cast(kind))
        return pa.table([pa.array(r[core], pa.int32()), pa.array(c[core], pa.int32()), *columns_out], names=["r", "c", *names])

    return spread.groupBy("_tr", "_tc").applyInArrow(run, f"r int, c int, {out}")


def fixpoint(df: DataFrame, fixed: list[str], state: str, kernel: Kernel, kind: str = "double", size: int = SIZE) -> DataFrame:
    """``state`` (with r, c and the fixed columns) after tiles have relaxed it, halo by halo, until no cell changes.

    kernel returns the relaxed state; each round every tile relaxes to rest and neighbours see its rim in the next. A
    round is one exchange: tiles hand on the fixed columns and tell by themselves whether they moved.
    """
    out = ", ".join([*(f"{x} double" for x in fixed), f"{state} double", "_moved boolean"])

    def relaxed(grid: dict, place: dict) -> dict:
        new, old = kernel(grid, place)["_new"], grid[state]
        return {**{x: grid[x] for x in fixed}, state: new, "_moved": ~((new == old) | (np.isnan(new) & np.isnan(old)))}

    now = df.select("r", "c", *fixed, F.col(state).cast("double").alias(state))
    for _ in range(ROUNDS):
        now = cut(tiled(now, [*fixed, state], relaxed, out, 1, size))
        if not now.where("_moved").limit(1).count():
            return now.drop("_moved").withColumn(state, F.col(state).cast(kind))
        now = now.drop("_moved")
    raise RuntimeError("no fix-point")
