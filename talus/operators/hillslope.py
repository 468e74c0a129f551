"""Soil depth from a nonlinear hillslope model, stepped on tiles: halos of 2 k cells hold k steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators.grid import extent
from talus.plans.checkpoints import cut
from talus.plans.tiles import SIZE

# Fixed values of the model: critical slope and its margin, step (years), bedrock lowering and its decay,
# density ratio, diffusivity.
SC, MARGIN, DT, P0, MU, RATIO, K = 1.25, 0.025, 1.0, 0.0003, 3.0, 2.0, 0.005
SPIN_UP = 500


def steps(endtime: float) -> int:
    """Steps of one year from 0 to endtime and the spin-up, both ends included."""
    return max(0, int(np.floor(endtime + SPIN_UP)) + 1)


def step(z: np.ndarray, rock: np.ndarray, rim: np.ndarray, dx: float) -> tuple[np.ndarray, np.ndarray]:
    """One year. rim: cells of the grid's outer ring, which keep their surface."""
    new_rock = np.where(np.isnan(z) | np.isnan(rock), rock, rock - DT * P0 * np.exp(-MU * (z - rock)))
    p = np.pad(z, 2, constant_values=np.nan)
    m, n = z.shape
    at = lambda a, b: p[2 + a : 2 + a + m, 2 + b : 2 + b + n]
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        gx, gy = (at(0, 1) - at(0, -1)) / (2 * dx), (at(1, 0) - at(-1, 0)) / (2 * dx)
        slope = np.sqrt(gx * gx + gy * gy)
        den = 1 - (slope / SC) ** 2
        lap = (at(0, -1) + at(0, 1) + at(-1, 0) + at(1, 0) - 4 * z) / (dx * dx)
        xx, yy = ((at(a, b) - 2 * z + at(-a, -b)) / (4 * dx * dx) for a, b in ((0, 2), (2, 0)))
        xy = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / (4 * dx * dx)
        curve = 2 * (gx * gx * xx + gy * gy * yy + 2 * gx * gy * xy)
        moved = z + K * DT / RATIO * (lap / den + curve / (SC * SC * den * den))
    calm = slope < SC * (1 - MARGIN)  # false beside no data
    whole = ~np.isnan(xx + yy + xy) & (den > 0)
    new = np.where(calm, np.fmax(np.where(whole, moved, z), new_rock), new_rock)
    keep = rim | np.isnan(z)
    return np.where(keep, z, new), new_rock


def advance(z: np.ndarray, rock: np.ndarray, rim: np.ndarray, dx: float, k: int, top: int = 0, bottom: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``k`` times ``step``; of the first ``top`` and last ``bottom`` rows only as much as the others still depend on.

    Cells without data stay so, hence which differences exist is known from the start. Rows lie behind one another with two
    cells without data between them, so that a neighbour is a shift, and stretches that fit the cache are worked off in turn.
    """
    m, n = z.shape
    w, edge = n + 2, 2 * (n + 2) + 2
    flat = lambda v, fill: np.concatenate((np.full(edge, fill), np.pad(v, ((0, 0), (0, 2)), constant_values=fill).ravel(), np.full(edge, fill)))
    z, rock, still = flat(z, np.nan), flat(rock, np.nan), flat(rim | np.isnan(z), True)
    new = z.copy()
    size = m * w
    at = lambda shift: z[edge + shift : edge + shift + size]
    with np.errstate(invalid="ignore"):
        partial = np.isnan(sum(at(x) for x in (2, -2, 2 * w, -2 * w, w + 1, w - 1, 1 - w, -1 - w)))
    length = max(w, 1 << 13)
    e = [np.empty(length + 2 * w) for _ in range(2)]
    t = [np.empty(length) for _ in range(6)]
    steep = 4 * dx * dx * (SC * (1 - MARGIN)) ** 2
    by_slope, by_lap, by_curve = 1 / (4 * dx * dx * SC * SC), K * DT / RATIO / (dx * dx), K * DT / RATIO * 2 / (SC * SC) / (4 * dx * dx) ** 2
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for done in range(1, k + 1):
            lo, hi = max(0, top - 2 * (k - done)) if top else 0, m - max(0, bottom - 2 * (k - done)) if bottom else m
            for a in range(lo * w, hi * w, length):
                b = min(a + length, hi * w)
                size, p = b - a, edge + a
                own, base = z[p : p + size], rock[p : p + size]
                # east minus west around the stretch as well, a row on each side; south minus north two cells on each side
                x, y = np.subtract(z[p - w + 1 : p + size + w + 1], z[p - w - 1 : p + size + w - 1], out=e[0][: size + 2 * w]), np.subtract(z[p : p + size + 2 * w], z[p - 2 * w : p + size], out=e[1][: size + 2 * w])
                gx, gy = x[w : w + size], y[w : w + size]
                q, u, v, s, d, f = (i[:size] for i in t)
                np.multiply(gx, gx, out=u)
                np.multiply(gy, gy, out=v)
                np.add(u, v, out=s)
                calm = s < steep
                np.multiply(s, -by_slope, out=d)
                d += 1
                np.divide(1, d, out=d)
                # second differences are differences of the first
                np.subtract(x[w + 1 : w + 1 + size], x[w - 1 : w - 1 + size], out=s)
                u *= s
                np.subtract(y[2 * w : 2 * w + size], y[:size], out=s)
                v *= s
                u += v
                np.subtract(x[2 * w : 2 * w + size], x[:size], out=s)
                s *= gx
                s *= gy
                s *= 2
                u += s
                u *= by_curve
                u *= d
                np.add(z[p + 1 : p + 1 + size], z[p - 1 : p - 1 + size], out=s)
                s += z[p + w : p + w + size]
                s += z[p - w : p - w + size]
                np.multiply(own, 4, out=f)
                s -= f
                s *= by_lap
                u += s
                u *= d
                u += own
                np.copyto(u, own, where=partial[a:b])
                np.subtract(own, base, out=q)
                q *= -MU
                np.exp(q, out=q)
                q *= DT * P0
                base -= q
                np.fmax(u, base, out=u)
                np.copyto(u, base, where=~calm)
                np.copyto(u, own, where=still[p : p + size])
                new[p : p + size] = u
            z, new = new, z
    back = lambda v: v[edge : edge + m * w].reshape(m, w)[:, :n]
    return back(z), back(rock)


def soil_depth(df: DataFrame, endtime: float = 5000.0, dx: float = 10.0, block: int = 64, size: int = 2 * SIZE) -> DataFrame:
    """df (z) with depth after the model has run; ``block`` steps an exchange.

    A tile is one row with its heights and rock; each round it hands itself and the strips that its neighbours need on.
    """
    m, n = extent(df)
    left, size = steps(endtime), max(size, 2 * block)
    if not left or not m:
        return df.withColumn("depth", F.col("z") - (F.col("z") - 1))
    cells = df.select("r", "c", F.col("z").cast("double").alias("z"))
    kind = "tr int, tc int, r0 int, c0 int, m int, n int, z binary, rock binary"

    def piece(tr: int, tc: int, r0: int, c0: int, z: np.ndarray, rock: np.ndarray) -> tuple:
        return tr, tc, r0, c0, *z.shape, z.astype(float).tobytes(), rock.astype(float).tobytes()

    def table(rows: list[tuple]) -> pa.Table:
        kinds = [pa.int32()] * 6 + [pa.binary()] * 2
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in kind.split(", ")])

    def dealt(tr: int, tc: int, z: np.ndarray, rock: np.ndarray) -> pa.Table:
        """A tile for itself, and its strips of 2 * block cells for those around it."""
        rows, h, r0, c0 = [], 2 * block, tr * size, tc * size
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                if 0 <= (tr + a) * size < m and 0 <= (tc + b) * size < n:
                    i, j = ({-1: slice(0, h), 0: slice(None), 1: slice(size - h, None)}[x] for x in (a, b))
                    rows.append(piece(tr + a, tc + b, r0 + (i.start or 0), c0 + (j.start or 0), z[i, j], rock[i, j]))
        return table(rows)

    def first(key, t):  # no type hints: they would choose another form of call
        tr, tc = (k.as_py() for k in key)
        z = np.full((min(size, m - tr * size), min(size, n - tc * size)), np.nan)
        z[t.column("r").to_numpy() - tr * size, t.column("c").to_numpy() - tc * size] = t.column("z").to_numpy()
        return dealt(tr, tc, z, z - 1)

    def moved(tr: int, tc: int, t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
        h = 2 * block
        r0, c0 = max(0, tr * size - h), max(0, tc * size - h)
        r1, c1 = min(m, (tr + 1) * size + h), min(n, (tc + 1) * size + h)
        z, rock = np.full((r1 - r0, c1 - c0), np.nan), np.full((r1 - r0, c1 - c0), np.nan)
        for x in t.to_pylist():
            at = slice(x["r0"] - r0, x["r0"] - r0 + x["m"]), slice(x["c0"] - c0, x["c0"] - c0 + x["n"])
            for grid, name in ((z, "z"), (rock, "rock")):
                grid[at] = np.frombuffer(x[name]).reshape(x["m"], x["n"])
        rim = np.zeros(z.shape, bool)
        for a, b, side in ((r0, 0, rim[0]), (r1, m, rim[-1]), (c0, 0, rim[:, 0]), (c1, n, rim[:, -1])):
            side |= a == b
        above, left_of = tr * size - r0, tc * size - c0
        core = slice(above, above + min(size, m - tr * size)), slice(left_of, left_of + min(size, n - tc * size))
        z, rock = advance(z, rock, rim, dx, k, above, r1 - min(m, (tr + 1) * size))
        return z[core], rock[core]

    tile = lambda x: F.floor(F.col(x) / size).cast("int")
    now = cut(cells.groupBy(tile("r").alias("tr"), tile("c").alias("tc")).applyInArrow(first, kind))
    while left > block:
        now, left = cut(now.groupBy("tr", "tc").applyInArrow(lambda key, t: dealt(*(at := [x.as_py() for x in key]), *moved(*at, t, block)), kind)), left - block

    def last(key, t):
        tr, tc = (k.as_py() for k in key)
        z, rock = moved(tr, tc, t, left)
        r, c = np.nonzero(~np.isnan(z - rock))
        return pa.table({"r": pa.array(r + tr * size, pa.int32()), "c": pa.array(c + tc * size, pa.int32()), "depth": pa.array((z - rock)[r, c])})

    return df.join(now.groupBy("tr", "tc").applyInArrow(last, "r int, c int, depth double"), ["r", "c"], "left")
