"""Cluster growth: force closure of unstable clusters that erode, grow downhill and stop.

A cluster depends on rasters only, so each (run, cluster) is one group. Its window is made by
an equi-join on tiles that the cluster's box plus ``reach`` covers; a cluster that needs a wider
window is sent again with twice the reach. Within a group windows widen by 20 cells from 20, keeping
the errors of earlier tries. Window cells are bounded by the box and ``max_offset``.

Tiles travel as one row each, with a value instead of an array where a field is the same all over. They hold what
all strengths share: a group computes the forces of its strength and their rotations where it needs them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators.geometry import cell_boundary, direction, measures, parts, traced, wedges
from talus.operators.physics import rotations
from talus.plans.checkpoints import cut

CONVERGED, NO_CELLS, NO_GAIN, MAX_CYCLES, NO_GEOMETRY, NO_WEIGHT, WINDOW_CAP = 0, 2, 3, 4, 5, 6, 7
_SKIPPED, _WIDER = -1, -2


@dataclass
class Settings:
    dx: float = 10.0
    dy: float = 10.0
    tolerance: float = 1.0
    cycles: int = 120
    least: int = 7
    erosions: int = 2
    s_roots: float = 10.0
    max_offset: int = 400
    step: int = 20
    grow: bool = True


def single(mask: np.ndarray) -> bool:
    """Exactly one 8-connected component."""
    return parts(mask)[1] == 1


def spur(cells: np.ndarray | list[tuple[int, int]]) -> int:
    """0 to 6: one column, one row, and row and column steps all 1 or all -1, in the order of cells."""
    if len(cells) <= 1:
        return 6 * len(cells)
    r, c = np.array(cells).T
    dr, dc = np.diff(r), np.diff(c)
    return sum(int(x.all()) for x in (c == c[0], r == r[0], dr == 1, dr == -1, dc == 1, dc == -1))


def ordered(mask: np.ndarray) -> np.ndarray:
    """Set cells (row, column) in column-major order."""
    c, r = np.nonzero(mask.T)
    return np.stack((r, c), axis=1)


def _lowest_around(values: np.ndarray) -> np.ndarray:
    p = np.pad(np.where(np.isnan(values), np.inf, values), 1, constant_values=np.inf)
    m, n = values.shape
    out = p[:m, :n].copy()
    for i, j in ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)):
        np.minimum(out, p[i : i + m, j : j + n], out=out)
    return out


def _spread(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    m, n = mask.shape
    across = p[:, :n] | p[:, 1 : n + 1] | p[:, 2:]
    return across[:m] | across[1 : m + 1] | across[2:]


def eroded(mask: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Without boundary cells that are lower than every cluster cell around them."""
    rim = mask & _spread(~np.pad(mask, 1))[1:-1, 1:-1]
    return mask & ~(rim & (z < _lowest_around(np.where(mask, z, np.nan))))


def downhill(mask: np.ndarray, z: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """Cells of the surrounding ring below all cluster cells around them, and whether the ring meets the window's edge."""
    around = _spread(mask) & ~mask
    if any(met(around)):
        return [], True
    return list(map(tuple, ordered(around & (z < _lowest_around(np.where(mask, z, np.nan)))).tolist())), False


def met(ring: np.ndarray) -> tuple[bool, bool, bool, bool]:
    """Whether the ring has cells on the top, bottom, left and right edge of the window."""
    return tuple(bool(x.any()) for x in (ring[0], ring[-1], ring[:, 0], ring[:, -1]))


def greedy(ex: float, ey: float, first: float, weight: float, qx: np.ndarray, qy: np.ndarray, w: np.ndarray) -> list[int]:
    """Candidates to add, in order: each time the one nearest to the error, up to the least error by weight (that of none taken is ``first``)."""
    qx, qy, left, taken, percent = np.array(qx, float), np.array(qy, float), np.arange(len(qx)), [], [first / weight * 100]
    while len(left):
        away = np.hypot(ex - qx[left], ey - qy[left])
        at = 0 if np.isnan(away[0]) else int(np.nanargmin(away))
        k = int(left[at])
        ex, ey, weight = ex + qx[k], ey + qy[k], weight + w[k]
        percent.append(np.hypot(ex, ey) / weight * 100)
        left = np.delete(left, at)
        taken.append(k)
    return taken[: int(np.argmin(percent))]


def forces(g: dict[str, np.ndarray], phi: float, coh: float, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, qx, qy) as ``physics.column_forces`` has them, of arrays z, w, pga, sigma_s, subdx, subdy: 0 without z, NaN in flat cells (qx, qy)."""
    sx, sy, turn = g["subdx"], g["subdy"], np.radians
    with np.errstate(invalid="ignore", divide="ignore"):
        m = np.sqrt(sx * sx + sy * sy)
        a, ax, ay = (turn(np.degrees(np.arctan(x))) for x in (m, sx, sy))
        area = s.dx * s.dy * np.sqrt(1 - np.sin(ax) * np.sin(ax) * np.sin(ay) * np.sin(ay)) / (np.cos(ax) * np.cos(ay))
        up, sin, cos, friction = g["sigma_s"] * area, np.sin(a), np.cos(a), np.tan(turn(phi))
        under = cos + sin * friction
        normal = (g["w"] + up * sin * friction - coh * area * sin) / np.where(under == 0, np.nan, under)
        q = normal * sin - (coh * area + (normal - up) * friction) * cos + g["pga"] * g["w"]
        m[m == 0] = np.nan
        off = np.isnan(g["z"])
        return tuple(np.where(off, 0.0, x) for x in (q, -sx / m * q, -sy / m * q))


def turned(g: dict[str, np.ndarray], phi: float, coh: float, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """qx and qy of cells by rotation of their gradients (``physics.project_slope``), rotations first."""
    length, turn, out = np.sqrt(g["subdx"] * g["subdx"] + g["subdy"] * g["subdy"]), np.degrees(np.arctan2(g["subdy"], g["subdx"])), []
    for rot in rotations():
        far, to = length * np.cos(np.radians(rot)), np.radians(turn + rot)
        out.append(forces(g | {"subdx": far * np.cos(to), "subdy": far * np.sin(to)}, phi, coh, s)[1:])
    return np.stack([x for x, _ in out]), np.stack([y for _, y in out])


#: Cells whose rotated forces are computed at once.
_CHUNK = 1 << 15


class _Cluster:
    def __init__(self, g: dict[str, np.ndarray], r0: int, c0: int, phi: float, coh: float, s: Settings, sums: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        self.g, self.r0, self.c0, self.phi, self.coh, self.s = g, r0, c0, phi, coh, s
        self.sums = {} if sums is None else sums

    def at(self, name: str, cells: np.ndarray | list[tuple[int, int]]) -> np.ndarray:
        r, c = np.asarray(cells, int).reshape(-1, 2).T
        return self.g[name][..., r, c]

    def geometry(self, mask: np.ndarray, cells: np.ndarray | list[tuple[int, int]], gamma: float) -> None:
        """Wedges around the cluster, their forces, and the force of roots along its boundary."""
        s = self.s
        path = at = traced(mask)
        x, y = (at[:, 1] + self.c0 + 1) * s.dx, (at[:, 0] + self.r0 + 1) * s.dy
        ring = cell_boundary(mask, s.dx, s.dy, self.r0, self.c0)
        if len(ring[0]) < 3 or len(path) < 3:
            raise ValueError("no outline")
        _, cx, cy, _ = measures(*ring)
        slide = direction(self.at("qy0", cells).sum(), self.at("qx0", cells).sum())
        depth = self.at("depth", path)
        k = wedges(at, x, y, depth, slide, (cx, cy), self.phi)
        turn = np.radians(k["direction"])
        weight = k["volume"] * gamma
        shake = float(np.mean(self.at("pga", cells))) * -np.cos(turn - np.radians(slide)) * weight
        sx, sy = k["fall"] * np.cos(turn), k["fall"] * np.sin(turn)
        with np.errstate(invalid="ignore", divide="ignore"):
            m = np.hypot(sx, sy)
            a, ax, ay, friction = np.arctan(m), np.arctan(sx), np.arctan(sy), np.tan(np.radians(self.phi))
            area = k["width"] * k["reach"] * np.sqrt(1 - (np.sin(ax) * np.sin(ay)) ** 2) / (np.cos(ax) * np.cos(ay))
            up = self.at("sigma_w", path) * area
            normal = (weight + up * np.sin(a) * friction - self.coh * area * np.sin(a)) / (np.cos(a) + np.sin(a) * friction)
            q = normal * np.sin(a) - (self.coh * area + (normal - up) * friction) * np.cos(a) + shake
            self.wx, self.wy = float(np.nansum(-sx / m * q)), float(np.nansum(-sy / m * q))
        self.wedge_weight = float(np.nansum(weight))
        wall = k["prism"] + 270 - slide
        holds = ((wall > -270) & (wall < -90)) | ((wall > 90) & (wall < 270)) | ((wall > 450) & (wall < 630))
        self.roots = float(np.nansum(s.s_roots * holds * (depth + np.roll(depth, -1)) / 2 * k["width"] * np.abs(np.cos(np.radians(wall)))))
        self.rx, self.ry = self.roots * np.cos(np.radians(slide)), self.roots * np.sin(np.radians(slide))

    def turns(self, cells: np.ndarray | list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """qx and qy by rotation: given, or computed for these cells."""
        if "qx" in self.g:
            return self.at("qx", cells), self.at("qy", cells)
        return turned({k: self.at(k, cells) for k in _LOADS}, self.phi, self.coh, self.s)

    def closure(self, cells: np.ndarray | list[tuple[int, int]]) -> None:
        """Force sums by rotation; those of a state go on from the state it grew from, whose cells come first."""
        n = len(cells)
        if n not in self.sums:
            done = max((k for k in self.sums if k < n), default=0)
            x, y = self.sums.get(done, (0.0, 0.0))
            for i in range(done, max(n, 1), _CHUNK):
                qx, qy = self.turns(cells[i : min(n, i + _CHUNK)])
                x, y = x + np.nansum(qx, axis=1), y + np.nansum(qy, axis=1)
            self.sums[n] = x, y
        x, y = self.sums[n]
        self.ex, self.ey = x + self.wx, y + self.wy
        self.err = np.hypot(self.ex, self.ey)

    def hold(self) -> None:
        """Roots taken off the errors; the signs differ by axis."""
        self.ex, self.ey, self.err = self.ex - self.rx, self.ey + self.ry, self.err - self.roots

    def gamma(self, cells: np.ndarray | list[tuple[int, int]]) -> float:
        volume = float(np.nansum(self.at("depth", cells))) * self.s.dx * self.s.dy
        return float(np.nansum(self.at("w", cells))) / volume if volume > 0 else 0.0


def grow(full: dict[str, np.ndarray], initial: np.ndarray, reach: int, phi: float, coh: float, s: Settings, origin: tuple[int, int] = (0, 0), whole: tuple[bool, bool, bool, bool] = (True,) * 4) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(code, cycles, eroded cells, final cells) in places of ``full``; code -1: skipped, -2: a wider window is needed.

    full: arrays of the box and ``reach`` cells around it (z, w, depth, pga, sigma_w, q0, qx0, qy0, nogrow, and qx, qy by
    rotation first, or sigma_s, subdx, subdy, of which they are computed); whole: sides (top, bottom, left, right) where it ends at the grid's edge.

    Each try begins with the same cells and adds the same ones until it ends, so that the number of cells names a state:
    its geometry and force sums are computed once, and what is stored of a cycle is that number.
    """
    rows, columns = np.nonzero(initial)
    box = rows.min(), rows.max(), columns.min(), columns.max()
    errors, store, longest, known = np.full(s.cycles + 2, np.nan), [None] * (s.cycles + 2), np.zeros((0, 2), int), {}
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    offset = 0
    while True:
        offset += s.step
        if offset > reach and not all(whole):
            return _WIDER, 0, [], []
        r0, r1 = max(0, box[0] - offset), min(initial.shape[0] - 1, box[1] + offset)
        c0, c1 = max(0, box[2] - offset), min(initial.shape[1] - 1, box[3] + offset)
        g = {k: v[..., r0 : r1 + 1, c0 : c1 + 1] for k, v in full.items()}
        k = _Cluster(g, origin[0] + r0, origin[1] + c0, phi, coh, s, sums)
        corner = np.array((r0, c0))
        first = initial[r0 : r1 + 1, c0 : c1 + 1]
        cells = ordered(first)
        if spur(cells) > 0 or not single(first):
            return _SKIPPED, 0, cells + corner, cells + corner
        mask = first
        for _ in range(s.erosions):
            mask = eroded(mask, g["z"])
        cells = ordered(mask)
        if len(cells) <= s.least or spur(cells) > 0 or not single(mask):
            mask, cells = first, ordered(first)
        was = cells + corner
        try:
            _known(known, k, mask, cells)
        except (ValueError, ZeroDivisionError, IndexError):
            return _SKIPPED, 0, ordered(first) + corner, ordered(first) + corner
        weight = float(np.nansum(k.at("w", cells)))
        k.closure(cells)
        emptied = bool(k.roots > k.err.max())
        if emptied:
            cells = cells[:0]
        else:
            k.hold()
        store[0] = len(cells)
        if weight + k.wedge_weight <= 0:
            return _SKIPPED, 0, ordered(first) + corner, ordered(first) + corner
        errors[0] = k.err.min() / (weight + k.wedge_weight) * 100
        before = errors.copy()
        allowed, code, done, cycle, slot, expand = s.tolerance / 100 * weight, CONVERGED, False, 0, 0, False
        best = lambda: max(longest, cells + corner, key=len)[: store[int(np.nanargmin(errors))]] - corner  # noqa: B023, E731
        while s.grow and k.err.min() > allowed and not emptied and not done:
            found, expand = downhill(mask, g["z"])
            if expand:
                break
            found = np.array(found, int).reshape(-1, 2)
            found = found[~g["nogrow"][*found.T] & ~np.isnan(g["q0"][*found.T])]
            if not len(found):
                done, code = True, NO_CELLS
                cells = best()
            else:
                slot, cycle = slot + 1, cycle + 1
                rot = int(np.argmin(k.err))
                taken = greedy(k.ex[rot], k.ey[rot], k.err.min(), weight + k.wedge_weight, *(q[rot] for q in k.turns(found)), k.at("w", found))
                if not taken or errors[slot - 1] < errors[slot]:
                    done, code = True, NO_GAIN
                cells = np.concatenate((cells, found[taken]))
            mask = np.zeros(first.shape, bool)
            mask[*cells.T] = True
            weight = float(np.nansum(k.at("w", cells)))
            if code != NO_CELLS:
                try:
                    _known(known, k, mask, cells)
                except (ValueError, ZeroDivisionError, IndexError):
                    code = NO_GEOMETRY
                    break
            k.closure(cells)
            k.hold()
            if slot <= s.cycles:
                store[slot] = len(cells)
                if weight + k.wedge_weight <= 0:
                    done, code = True, NO_WEIGHT
                else:
                    errors[slot] = k.err.min() / (weight + k.wedge_weight) * 100
            allowed = s.tolerance / 100 * weight
            if cycle >= s.cycles:
                done, code = True, MAX_CYCLES
                cells = best()
        if expand and offset < s.max_offset:
            longest = max(longest, cells + corner, key=len)
            # at an edge of the grid a wider window ends the same way, unless this try has left other errors to compare with
            edges = (r0 == 0, r1 == initial.shape[0] - 1, c0 == 0, c1 == initial.shape[1] - 1)
            fixed = any(a and b and c for a, b, c in zip(met(_spread(mask) & ~mask), edges, whole, strict=True))
            if not fixed or not np.array_equal(before, errors, equal_nan=True):
                continue
        return (WINDOW_CAP if expand else code), cycle, was, cells + corner


def _known(known: dict, k: _Cluster, mask: np.ndarray, cells: np.ndarray) -> None:
    """The geometry of a cluster's state, computed when it is first met."""
    if (n := len(cells)) not in known:
        k.geometry(mask, ordered(mask), k.gamma(cells))
        known[n] = k.wx, k.wy, k.wedge_weight, k.roots, k.rx, k.ry
    k.wx, k.wy, k.wedge_weight, k.roots, k.rx, k.ry = known[n]


#: What forces are computed of, and what tiles hold.
_LOADS = ("z", "w", "pga", "sigma_s", "subdx", "subdy")
_FIELDS = (*_LOADS, "depth", "sigma_w", "nogrow")


def bounds(clusters: DataFrame, *more) -> DataFrame:
    """(run, cluster, b0, b1, b2, b3): first and last row and column of each cluster; more: other aggregates."""
    return clusters.groupBy("run", "cluster").agg(F.min("r").alias("b0"), F.max("r").alias("b1"), F.min("c").alias("b2"), F.max("c").alias("b3"), *more)


def windows(boxes: DataFrame, rasters: DataFrame, reach: int, tile: int = 64) -> DataFrame:
    """Rows of rasters (run, r, c and others) in each box of its run and ``reach`` cells around it, by an equi-join on the tiles that this covers."""
    covered = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(lo) - reach) / tile).cast("int"), F.floor((F.col(hi) + reach) / tile).cast("int")))
    wanted = boxes.withColumn("_tr", covered("b0", "b1")).withColumn("_tc", covered("b2", "b3"))
    tiled = rasters.withColumns({"_tr": F.floor(F.col("r") / tile).cast("int"), "_tc": F.floor(F.col("c") / tile).cast("int")})
    near = F.col("r").between(F.col("b0") - reach, F.col("b1") + reach) & F.col("c").between(F.col("b2") - reach, F.col("b3") + reach)
    return wanted.join(tiled, ["run", "_tr", "_tc"]).where(near).drop("_tr", "_tc")


def in_tiles(df: DataFrame, tile: int) -> DataFrame:
    """df (r, c) with the tile of each cell (_tr, _tc) and its place there (_at)."""
    at = (F.col("r") % tile) * tile + F.col("c") % tile
    return df.withColumns({"_tr": F.floor(F.col("r") / tile).cast("int"), "_tc": F.floor(F.col("c") / tile).cast("int"), "_at": at.cast("int")})


def packed(clusters: DataFrame, tile: int = 32) -> DataFrame:
    """Clusters (run, cluster, r, c, phi, coh) as a row for each tile that they have cells in, with the places in it."""
    return in_tiles(clusters, tile).groupBy("run", "cluster", "phi", "coh", "_tr", "_tc").agg(F.collect_list("_at").alias("_own"))


def unpacked(rows: DataFrame, tile: int = 32) -> DataFrame:
    """The cells of packed clusters again."""
    each = rows.select("run", "cluster", "phi", "coh", "_tr", "_tc", F.explode("_own").alias("_at"))
    place = lambda t, x: (F.col(t) * tile + x).cast("int")
    return each.select("run", "cluster", place("_tr", F.floor(F.col("_at") / tile)).alias("r"), place("_tc", F.col("_at") % tile).alias("c"), "phi", "coh")


def _pack(tile: int):
    def run(key, table):  # no type hints: they would choose another form of call
        at = table.column("_at").to_numpy()
        order = np.argsort(at)
        fields = []
        for k in _FIELDS:
            v = table.column(k).to_numpy().astype(float)[order]
            same = (v == v[0]).all() or np.isnan(v).all()
            fields.append((v[:1] if same else v).tobytes())
        cells = b"" if len(at) == tile * tile else at[order].astype(np.int32).tobytes()
        return pa.table({"_tr": pa.array([key[0].as_py()], pa.int32()), "_tc": pa.array([key[1].as_py()], pa.int32()), "_cells": pa.array([cells], pa.binary()), "_fields": pa.array([fields], pa.list_(pa.binary()))})

    return run


def grow_clusters(clusters: DataFrame, rasters: DataFrame, settings: Settings | None = None, tile: int = 32, reach: int = 40, own: DataFrame | None = None) -> DataFrame:
    """(run, cluster, r, c, kind, code, cycles): kind initial, eroded or final; painted where code >= 0.

    clusters: run, cluster, r, c, phi, coh. rasters: r, c (a row for each cell at most), z, w, depth, pga, sigma_s, sigma_w, subdx, subdy, nogrow.
    own: the clusters packed in tiles of this size, if they are there already.
    """
    s = settings or Settings()
    m, n = rasters.agg(F.max("r") + 1, F.max("c") + 1).first()
    if m is None:
        return clusters.select("run", "cluster", "r", "c", F.lit("initial").alias("kind"), F.lit(0).alias("code"), F.lit(0).alias("cycles")).limit(0)
    values = in_tiles(rasters, tile).select("_tr", "_tc", "_at", *(F.col(k).cast("double").alias(k) for k in _FIELDS))
    tiles = cut(values.groupBy("_tr", "_tc").applyInArrow(_pack(tile), "_tr int, _tc int, _cells binary, _fields array<binary>"))
    todo = cut(bounds(clusters, F.first("phi").alias("phi"), F.first("coh").alias("coh")))
    own = (packed(clusters, tile) if own is None else own).drop("phi", "coh")
    covered = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(lo) - reach) / tile).cast("int"), F.floor((F.col(hi) + reach) / tile).cast("int")))
    done = []
    while True:
        wanted = todo.withColumn("_tr", covered("b0", "b1")).withColumn("_tc", covered("b2", "b3"))
        rows = wanted.join(tiles, ["_tr", "_tc"]).unionByName(own, allowMissingColumns=True)
        got = cut(rows.groupBy("run", "cluster").applyInArrow(_group(s, reach, m, n, tile), "run int, cluster long, r array<int>, c array<int>, kind string, code int, cycles int"))
        done.append(got.where(F.col("code") != _WIDER))
        again = got.where(F.col("code") == _WIDER).select("run", "cluster").distinct()
        if not again.limit(1).count():
            break
        todo, reach = cut(todo.join(again, ["run", "cluster"], "left_semi")), reach * 2
        own = own.join(again, ["run", "cluster"], "left_semi")
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out.withColumn("_x", F.explode(F.arrays_zip("r", "c"))).select("run", "cluster", "_x.r", "_x.c", "kind", "code", "cycles")


#: Cells handed back in a row.
_ROWS = 1 << 14


def _group(s: Settings, reach: int, m: int, n: int, tile: int):
    def run(key: tuple[Any, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: dict[str, np.ndarray] = {}
        ends, own = [m, -1, n, -1], []
        every = np.arange(tile * tile, dtype=np.int32)
        for t in batches:
            mine = t.column("_own").is_valid()
            if mine.true_count:
                some = t.filter(mine)
                count, places = some.column("_own").value_lengths().to_numpy(), some.column("_own").flatten().to_numpy()
                own.append([np.repeat(some.column(k).to_numpy(), count) * tile + x for k, x in (("_tr", places // tile), ("_tc", places % tile))])
                t = t.filter(pc.invert(mine))
            if not t.num_rows:
                continue
            if not full:
                box = [t.column(k)[0].as_py() for k in ("b0", "b1", "b2", "b3")]
                phi, coh = t.column("phi")[0].as_py(), t.column("coh")[0].as_py()
                r0, c0 = max(0, box[0] - reach), max(0, box[2] - reach)
                shape = min(m - 1, box[1] + reach) - r0 + 1, min(n - 1, box[3] + reach) - c0 + 1
                full = {k: np.full(shape, np.nan) for k in _FIELDS if k != "nogrow"}
                full["nogrow"] = np.zeros(shape, bool)
            for i in range(t.num_rows):
                cells = t.column("_cells")[i].as_py()
                at = np.frombuffer(cells, np.int32) if cells else every
                r, c = at // tile + (t.column("_tr")[i].as_py() * tile - r0), at % tile + (t.column("_tc")[i].as_py() * tile - c0)
                near = (r >= 0) & (r < shape[0]) & (c >= 0) & (c < shape[1])
                if not near.any():
                    continue
                r, c = r[near], c[near]
                ends = [min(ends[0], r.min()), max(ends[1], r.max()), min(ends[2], c.min()), max(ends[3], c.max())]
                for k, x in zip(_FIELDS, t.column("_fields")[i].as_py(), strict=True):
                    v = np.frombuffer(x)
                    v = v[near] if len(v) > 1 else v
                    full[k][r, c] = np.nan_to_num(v) > 0 if k == "nogrow" else v
        if not full:
            return
        initial = np.zeros(shape, bool)
        for r, c in own:
            initial[r - r0, c - c0] = True
        have = slice(ends[0], ends[1] + 1), slice(ends[2], ends[3] + 1)
        full, initial, r0, c0 = {k: v[have] for k, v in full.items()}, initial[have], r0 + int(ends[0]), c0 + int(ends[2])
        made = [np.empty(initial.shape) for _ in range(3)]
        lines = max(1, _CHUNK // initial.shape[1])
        for i in range(0, len(initial), lines):
            for x, v in zip(made, forces({k: full[k][i : i + lines] for k in _LOADS}, phi, coh, s), strict=True):
                x[i : i + lines] = v
        full |= dict(zip(("q0", "qx0", "qy0"), made, strict=True))
        # beyond data nothing has a force: NaN there, so that growth leaves those cells out
        full["q0"][np.isnan(full["z"])] = np.nan
        whole = (box[0] - reach <= 0, box[1] + reach >= m - 1, box[2] - reach <= 0, box[3] + reach >= n - 1)
        code, cycles, was, final = grow(full, initial, reach, phi, coh, s, (r0, c0), whole)
        full.clear()
        for kind, cells in {"initial": ordered(initial), **({} if code == _WIDER else {"eroded": was, "final": final})}.items():
            for i in range(0, len(cells), _ROWS):
                part = cells[i : i + _ROWS]
                yield pa.RecordBatch.from_pydict(
                    {
                        "run": pa.array([key[0].as_py()], pa.int32()), "cluster": pa.array([key[1].as_py()], pa.int64()),
                        "r": pa.array([(part[:, 0] + r0).astype(np.int32)], pa.list_(pa.int32())), "c": pa.array([(part[:, 1] + c0).astype(np.int32)], pa.list_(pa.int32())),
                        "kind": pa.array([kind]), "code": pa.array([code], pa.int32()), "cycles": pa.array([cycles], pa.int32()),
                    }
                )

    return run
