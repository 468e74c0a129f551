"""Outlines of clusters: boundary traces, polygon measures, alpha shapes, wedges and root forces."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.degrees import cosd, sind

_CLOCK = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def trace(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Outer boundary of a component, clockwise by Moore neighbours from its first cell in column-major order, without the closing cell.

    The walk ends where it would leave the first cell again as it left it first.
    """
    if not cells:
        return []
    start = min(cells, key=lambda p: (p[1], p[0]))
    path, at, came, leave = [start], start, 0, None
    while True:
        step = next((d for k in range(1, 9) if (at[0] + _CLOCK[d := (came + k) % 8][0], at[1] + _CLOCK[d][1]) in cells), None)
        if step is None:
            return path
        if at == start:
            if leave == step:
                return path[:-1] if len(path) > 1 and path[-1] == start else path
            leave = step if leave is None else leave
        at = (at[0] + _CLOCK[step][0], at[1] + _CLOCK[step][1])
        came = (step + 4) % 8
        path.append(at)


def traced(mask: np.ndarray) -> np.ndarray:
    """The path of ``trace`` over the set cells of a mask, as an array of (row, column)."""
    on = np.pad(mask, 1)
    m, n = mask.shape
    if not mask.any():
        return np.zeros((0, 2), int)
    code = np.zeros(on.shape, np.uint8)
    for k, (a, b) in enumerate(_CLOCK):
        code[1:-1, 1:-1] |= on[1 + a : 1 + a + m, 1 + b : 1 + b + n].astype(np.uint8) << k
    around, move = code.tobytes(), [a * (n + 2) + b for a, b in _CLOCK]
    c = int(mask.any(axis=0).argmax())
    start = (int(mask[:, c].argmax()) + 1) * (n + 2) + c + 1
    path, at, came, leave = [start], start, 0, None
    while (step := _TURN[came][around[at]]) >= 0:
        if at == start:
            if leave == step:
                path = path[:-1] if len(path) > 1 and path[-1] == start else path
                break
            leave = step if leave is None else leave
        at += move[step]
        came = (step + 4) % 8
        path.append(at)
    return np.stack(np.divmod(np.array(path), n + 2), axis=1) - 1


#: The next side with a cell, clockwise from where the walk came, by the sides that have one (a bit each); -1: none.
_TURN = [[next((d for k in range(1, 9) if bits >> (d := (came + k) % 8) & 1), -1) for bits in range(256)] for came in range(8)]


def boundaries(labelled: DataFrame, by: str = "root") -> DataFrame:
    """(by, seq, r, c): the outer boundary of every component of (by, r, c), closed by its first cell; holes have none.

    A component is traced whole in one task; of its cells only those with a neighbour outside go there, which a
    walk along the outside never leaves.
    """
    keys = [by, "r", "c"]
    cells = labelled.select(*keys)
    moved = [cells.select(by, (F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    hits = moved[0].unionAll(moved[1]).unionAll(moved[2]).unionAll(moved[3]).groupBy(*keys).count().where("count = 4")
    rim = cells.join(hits, keys, "left_anti")
    kind = labelled.schema[by].dataType.simpleString()

    def run(key, table):  # no type hints: they would choose another form of call
        path = trace(set(zip(table.column("r").to_pylist(), table.column("c").to_pylist(), strict=True)))
        path.append(path[0])
        r, c = zip(*path, strict=True)
        n = len(path)
        return pa.table({by: pa.array([key[0].as_py()] * n, table.schema.field(by).type), "seq": pa.array(range(n), pa.int32()), "r": pa.array(r, pa.int32()), "c": pa.array(c, pa.int32())})

    return rim.groupBy(by).applyInArrow(run, f"`{by}` {kind}, seq int, r int, c int")


def measures(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Area, centroid and perimeter of an open loop of vertices by boundary integrals."""
    if len(x) < 3:
        return 0.0, float(np.mean(x)) if len(x) else 0.0, float(np.mean(y)) if len(y) else 0.0, 0.0
    xm, ym = x.mean(), y.mean()
    u, v = x - xm, y - ym
    du, dv = np.roll(u, -1) - u, np.roll(v, -1) - v
    twice = u * np.roll(v, -1) - np.roll(u, -1) * v
    area, length = twice.sum() / 2, np.hypot(du, dv).sum()
    if area == 0:
        return 0.0, float(xm), float(ym), float(length)
    cx, cy = ((2 * w + d) * twice for w, d in ((u, du), (v, dv)))
    return abs(float(area)), float(cx.sum() / (6 * area) + xm), float(cy.sum() / (6 * area) + ym), float(length)


def polygon_measures(df: DataFrame, by: str = "poly", order: str = "seq") -> DataFrame:
    """(by, area, cx, cy, perimeter) of vertices (x, y) in order, each loop closed by itself."""
    w = Window.partitionBy(by)
    o = w.orderBy(order)
    rel = df.select(by, order, *[(F.col(k) - F.avg(k).over(w)).alias(f"_{k}") for k in "xy"], *[F.avg(k).over(w).alias(f"_{k}m") for k in "xy"])
    nxt = rel.withColumns({f"_{k}n": F.coalesce(F.lead(f"_{k}").over(o), F.first(f"_{k}").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) for k in "xy"})
    twice = F.col("_x") * F.col("_yn") - F.col("_xn") * F.col("_y")
    sums = nxt.groupBy(by).agg(
        F.count("*").alias("_n"), (F.sum(twice) / 2).alias("_a"), F.sum((F.col("_x") + F.col("_xn")) * twice).alias("_cx"), F.sum((F.col("_y") + F.col("_yn")) * twice).alias("_cy"),
        F.sum(F.hypot(F.col("_xn") - F.col("_x"), F.col("_yn") - F.col("_y"))).alias("_p"), F.first("_xm").alias("_xm"), F.first("_ym").alias("_ym"),
    )
    some = F.col("_n") >= 3
    at = lambda k: F.col(f"_{k}m") + F.when(some, F.coalesce(F.try_divide(F.col(f"_c{k}"), 6 * F.col("_a")), F.lit(0.0))).otherwise(0.0)
    return sums.select(by, F.when(some, F.abs("_a")).otherwise(0.0).alias("area"), at("x").alias("cx"), at("y").alias("cy"), F.when(some, F.col("_p")).otherwise(0.0).alias("perimeter"))


def circumradius(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Radius of the circle through three points, null (for infinite) if they are in line."""
    twice = F.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))
    product = F.hypot(bx - ax, by - ay) * F.hypot(cx - bx, cy - by) * F.hypot(ax - cx, ay - cy)
    return F.when(twice > 0, product / (2 * twice))


def root_force(df: DataFrame, s_roots: float = 10.0, s_healthy: float | None = None, by: str = "cluster", order: str = "seq") -> DataFrame:
    """(by, force, fx, fy) of boundary rows (prism_dir, depth, width, slide_dir, burn): roots hold in three bands of angles."""
    o = Window.partitionBy(by).orderBy(order)
    turn = F.col("prism_dir") + 270 - F.col("slide_dir")
    after = F.coalesce(F.lead("depth").over(o), F.first("depth").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = df.withColumns({"_turn": turn, "_depth": (F.col("depth") + after) / 2})
    t = F.col("_turn")
    holds = ((t > -270) & (t < -90)) | ((t > 90) & (t < 270)) | ((t > 450) & (t < 630))
    strength = F.lit(s_roots) if s_healthy is None else F.when(F.col("burn") >= 3, s_roots).otherwise(s_healthy)
    each = F.when(holds, strength * F.col("_depth") * F.col("width") * F.abs(cosd(t))).otherwise(0.0)
    out = rows.groupBy(by).agg(F.sum(each).alias("force"), F.first("slide_dir").alias("_dir"))
    return out.select(by, "force", (F.col("force") * cosd(F.col("_dir"))).alias("fx"), (F.col("force") * sind(F.col("_dir"))).alias("fy"))


def pressure_angle(direction: Column | np.ndarray, phi):
    """Inclination of a wedge's failure plane by its direction from the slide's (0-360): 45 - phi/2 ahead, 45 + phi/2 behind.

    Linear on both halves; the way back starts one degree after 180.
    """
    if isinstance(direction, Column):
        ahead = 45 - phi / 2 + phi * direction / 180
        back = F.when(direction >= 181, 45 + phi / 2 - phi * (direction - 181) / 179).otherwise(45 + phi / 2)
        return F.when(direction <= 180, ahead).otherwise(back)
    knots = np.arange(361.0)
    values = np.concatenate((np.linspace(45 - phi / 2, 45 + phi / 2, 181), np.linspace(45 + phi / 2, 45 - phi / 2, 180)))
    return np.interp(direction, knots, values)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, by monotone chains."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    side = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for run in (pts, pts[::-1]):
        half: list = []
        for p in run:
            while len(half) > 1 and side(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def delaunay(points: np.ndarray, every: np.ndarray | None = None) -> np.ndarray:
    """Triangles (counter-clockwise point numbers) by insertion along the longer side; circles that lie behind are tested no more.

    every: points whose middle and span set the outer triangle, if other than ``points``.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    every = points if every is None else every
    centre, span = every.mean(0), max(1e-9, float(np.ptp(every, axis=0).max()))
    p = np.vstack((points, centre + 1e4 * span * np.array([[-1.0, -1.0], [1.0, -1.0], [0.0, 1.0]])))
    if np.ptp(points[:, 1]) > np.ptp(points[:, 0]):  # a quarter turn
        p = np.column_stack((p[:, 1], -p[:, 0]))
    tri = np.array([[n, n + 1, n + 2]])
    if n <= _FEW:
        return _swept(p, tri)
    circle, behind = _circles(p, tri), []
    for i in np.argsort(p[:n, 0], kind="stable").tolist():
        x, y = p[i]
        past = (x > circle[:, 0]) & ((x - circle[:, 0]) ** 2 >= circle[:, 2])
        if past.any():
            behind.append(tri[past])
            tri, circle = tri[~past], circle[~past]
            if len(behind) > 4096:
                behind = [np.vstack(behind)]
        hit = (circle[:, 0] - x) ** 2 + (circle[:, 1] - y) ** 2 < circle[:, 2] * (1 - 1e-12)
        edges = {(int(t[k]), int(t[(k + 1) % 3])) for t in tri[hit] for k in range(3)}
        rim = [(a, b) for a, b in edges if (b, a) not in edges and (p[a][0] - x) * (p[b][1] - y) - (p[a][1] - y) * (p[b][0] - x) > 0]
        new = np.array([(a, b, i) for a, b in sorted(rim)], int).reshape(-1, 3)
        tri, circle = np.vstack((tri[~hit], new)), np.vstack((circle[~hit], _circles(p, new)))
    tri = np.vstack([*behind, tri])
    return tri[(tri < n).all(axis=1)]


#: Points that ``delaunay`` inserts without arrays, whose calls would take longer than the few triangles in play.
_FEW = 1000


def _swept(p: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """The triangles of ``delaunay`` for few points p, by the same arithmetic over lists; outer: the triangle of the last three of p."""
    n, at, behind = len(p) - 3, p.tolist(), []
    live = [(*_circles(p, outer)[0].tolist(), *outer[0].tolist())]
    for i in np.argsort(p[:n, 0], kind="stable").tolist():
        x, y = at[i]
        stay, edges = [], set()
        for t in live:
            away = (x - t[0]) * (x - t[0])
            if x > t[0] and away >= t[2]:
                behind.append(t[3:])
            elif away + (t[1] - y) * (t[1] - y) < t[2] * (1 - 1e-12):
                edges.update(((t[3], t[4]), (t[4], t[5]), (t[5], t[3])))
            else:
                stay.append(t)
        for a, b in sorted(edges):
            (ax, ay), (bx, by) = at[a], at[b]
            if (b, a) in edges or not (ax - x) * (by - y) - (ay - y) * (bx - x) > 0:
                continue
            bx, by, cx, cy = bx - ax, by - ay, x - ax, y - ay
            if (twice := 2 * (bx * cy - by * cx)) == 0:
                stay.append((*_circles(p, np.array([[a, b, i]]))[0].tolist(), a, b, i))
                continue
            b2, c2 = bx * bx + by * by, cx * cx + cy * cy
            u, v = (cy * b2 - by * c2) / twice, (bx * c2 - cx * b2) / twice
            stay.append((u + ax, v + ay, u * u + v * v, a, b, i))
        live = stay
    tri = np.array([*behind, *(t[3:] for t in live)], int).reshape(-1, 3)
    return tri[(tri < n).all(axis=1)]


def _circles(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Centre and squared radius of the circle through each triangle's points."""
    a = p[tri[:, 0]]
    b, c = p[tri[:, 1]] - a, p[tri[:, 2]] - a
    twice = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    b2, c2 = (b * b).sum(1), (c * c).sum(1)
    u = np.stack(((c[:, 1] * b2 - b[:, 1] * c2) / twice, (b[:, 0] * c2 - c[:, 0] * b2) / twice), axis=1)
    return np.column_stack((u + a, (u * u).sum(1)))


def alpha_boundary(points: np.ndarray, shrink: float = 0.5) -> list[int]:
    """Point numbers of the outline between the tightest single region of all points and the hull, counter-clockwise.

    Triangles with circumradius up to r + (1 - shrink) (R - r) stay, R being the largest and r the least
    that joins all points by shared edges; the hull where that fails.
    """
    tri = delaunay(points)
    numbers = {tuple(p): i for i, p in reversed(list(enumerate(points.tolist())))}
    around = [numbers[tuple(p)] for p in hull([tuple(p) for p in points.tolist()])]
    if not len(tri):
        return around
    radius = _radii(points, tri)
    shared: dict[tuple[int, int], list[int]] = {}
    for k, t in enumerate(tri.tolist()):
        for i in range(3):
            shared.setdefault(tuple(sorted((t[i], t[(i + 1) % 3]))), []).append(k)
    parent, on, seen, parts, least = list(range(len(tri))), np.zeros(len(tri), bool), set(), 0, None

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in np.argsort(radius, kind="stable").tolist():
        if not np.isfinite(radius[k]):
            break
        on[k], parts = True, parts + 1
        seen.update(tri[k].tolist())
        for i in range(3):
            for j in shared[tuple(sorted((tri[k][i], tri[k][(i + 1) % 3])))]:
                if on[j] and find(j) != find(k):
                    parent[find(j)] = find(k)
                    parts -= 1
        if parts == 1 and len(seen) == len(numbers):
            least = radius[k]
            break
    if least is None:
        return around
    keep = radius <= least + (1 - shrink) * (radius[np.isfinite(radius)].max() - least) + 1e-12
    nxt: dict[int, list[int]] = {}
    for k in np.flatnonzero(keep).tolist():
        for i in range(3):
            u, v = int(tri[k][i]), int(tri[k][(i + 1) % 3])
            if sum(keep[j] for j in shared[tuple(sorted((u, v)))]) == 1:
                nxt.setdefault(u, []).append(v)
    return _longest(points, nxt) or around


def _radii(points: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Circumradius of each triangle, infinite if its points are in line."""
    a, b, c = (points[tri[:, k]] for k in range(3))
    sides = [np.hypot(*(u - v).T) for u, v in ((a, b), (b, c), (c, a))]
    twice = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]))
    return np.where(twice > 0, sides[0] * sides[1] * sides[2] / np.maximum(2 * twice, 1e-300), np.inf)


def _longest(points: np.ndarray, nxt: dict[int, list[int]]) -> list[int]:
    """The loop of the largest area; nxt: where edges lead from each point. Where several leave, the one next to the outside is taken, so that holes stay apart."""
    best, size, starts, i = [], -1.0, sorted(nxt), 0
    while nxt:
        while starts[i] not in nxt:
            i += 1
        loop = [starts[i]]
        while ways := nxt.get(loop[-1]):
            if len(ways) > 1:
                x, y = points[loop[-1]]
                back = math.atan2(points[loop[-2]][1] - y, points[loop[-2]][0] - x) if len(loop) > 1 else math.pi
                ways.sort(key=lambda q: (math.atan2(points[q][1] - y, points[q][0] - x) - back) % (2 * math.pi), reverse=True)  # noqa: B023
            to = ways.pop()
            if not ways:
                del nxt[loop[-1]]
            if to == loop[0]:
                break
            loop.append(to)
        area = measures(points[loop, 0], points[loop, 1])[0]
        if area > size:
            best, size = loop, area
    return best


def parts(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Number of each set cell's component (from 0; -1: not set), and how many there are; by stretches of rows."""
    m, n = mask.shape
    w, k = n + 2, int(diagonal)
    flat = np.pad(mask, 1).ravel().astype(np.int8)
    turn = np.flatnonzero(np.diff(flat)) + 1
    begin, end = turn[::2], turn[1::2]  # the end is the first cell behind
    lo, hi = np.searchsorted(end, begin + w - k, side="right"), np.searchsorted(begin, end + w - 1 + k, side="right")
    many = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(begin)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    parent = list(range(len(begin)))
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if u < v:
            parent[v] = u
        else:
            parent[u] = v
    for u, v in enumerate(parent):
        parent[u] = parent[v]  # v <= u is settled
    roots, label = np.unique(np.array(parent, int), return_inverse=True)
    out = np.full(len(flat), -1)
    out[flat > 0] = np.repeat(label, end - begin)
    return out.reshape(m + 2, w)[1:-1, 1:-1], len(roots)


#: Cells across a gap up to which triangles are kept by its shape: no circle through three of its cells reaches an outer triangle.
_SHAPE = 100


def gap_triangles(mask: np.ndarray, dx: float, dy: float) -> np.ndarray | None:
    """Triangles (of cells: row, column) of the triangulation of all set cells outside the squares of four; None if the set cells are not one component.

    Links between set cells side by side or corner to corner are edges of the triangulation (but across squares of four),
    so that what they enclose is triangulated by itself: a square of three is one triangle, and the others lie in holes,
    or in bays between the outer boundary and the hull. Gaps of the same shape are triangulated once.
    """
    if parts(mask)[1] != 1:
        return None
    scale = np.array((dy, dx))
    r, c = np.nonzero(mask)
    # two points with the middle and the span of all
    reach = max(np.ptp(r) * dy, np.ptp(c) * dx) / 2 / scale
    middle = np.array((r.mean(), c.mean())) + np.stack((-reach, reach))
    found = [_halves(mask)]
    label, k = parts(np.pad(~mask, 1, constant_values=True), False)
    r, c = np.nonzero((label >= 0) & (label != label[0, 0]))
    at = label[r, c]
    order = np.argsort(at, kind="stable")
    cells, at = np.stack((r, c), axis=1)[order] - 1, at[order]
    begin = np.flatnonzero(np.append(True, np.diff(at) != 0)) if len(at) else np.zeros(0, int)
    found += _by_shape(cells, begin, np.append(begin[1:], len(at)), lambda x: _in_hole(x, scale, middle))
    path = traced(mask)
    _, again, times = np.unique(path[:, 0] * mask.shape[1] + path[:, 1], return_inverse=True, return_counts=True)
    ends = np.flatnonzero(_on_hull(path) & (times[again] == 1))
    if len(ends):
        path, ends = np.roll(path, -ends[0], axis=0), ends - ends[0]
    else:
        ends = np.zeros(1, int)
    path = np.concatenate((path, path[:1]))
    begin, end = ends, np.append(ends[1:], len(path) - 1) + 1
    some = end - begin > 2
    found += _by_shape(path, begin[some], end[some], lambda x: _in_bay(x, scale, middle))
    return np.concatenate(found)


def _halves(mask: np.ndarray) -> np.ndarray:
    """The triangles of the squares that have three set cells, counter-clockwise by column and row."""
    corners = ((0, 0), (0, 1), (1, 1), (1, 0))
    m, n = mask.shape
    on = [mask[a : m - 1 + a, b : n - 1 + b] for a, b in corners]
    out = [np.zeros((0, 3, 2), int)]
    for k in range(4):
        r, c = np.nonzero(~on[k] & on[k - 1] & on[k - 2] & on[k - 3])
        out.append(np.stack([np.stack((r + a, c + b), axis=1) for a, b in (corners[(k + j) % 4] for j in (1, 2, 3))], axis=1))
    return np.concatenate(out)


def _by_shape(cells: np.ndarray, begin: np.ndarray, end: np.ndarray, make) -> list[np.ndarray]:
    """make(cells) for each stretch of cells, moved to where it lies; once for all stretches that are alike."""
    if not len(begin):
        return []
    cells = cells.astype(np.int32)
    corner = cells[begin]
    places: dict[bytes, list[int]] = {}
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        own = cells[a:b]
        wide = b - a > _SHAPE - 2 and np.ptp(own, axis=0).max() > _SHAPE - 2
        places.setdefault(i if wide else (own - corner[i]).tobytes(), []).append(i)
    out = []
    for same in places.values():
        i = same[0]
        made = make(cells[begin[i] : end[i]].astype(int)) - corner[i]
        out.append((made[None] + corner[same][:, None, None]).reshape(-1, 3, 2))
    return out


def _around(cells: np.ndarray, scale: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """``delaunay`` of cells (row, column), as triangles of cells; middle: what sets the outer triangle (row, column) if they reach far."""
    every = None if np.ptp(cells, axis=0).max() <= _SHAPE else (middle * scale)[:, ::-1]
    return cells[delaunay((cells * scale)[:, ::-1], every)]


def _in_hole(hole: np.ndarray, scale: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Triangles within a hole (unset cells that are connected by sides) and the links around it."""
    low = hole.min(0) - 1
    own = np.zeros(np.ptp(hole, axis=0) + 4, bool)
    own[*(hole - low).T] = True
    beside = np.zeros(own.shape, bool)
    beside[1:] |= own[:-1]
    beside[:-1] |= own[1:]
    beside[:, 1:] |= own[:, :-1]
    beside[:, :-1] |= own[:, 1:]
    tri = _around(np.argwhere(beside & ~own) + low, scale, middle)
    # a hole has all of a square but, where three corners are set, the half at its own corner
    (i, j), (y, x) = (k.T for k in np.divmod((tri - low).sum(1), 3))
    sides = ((0, 0), (0, 1), (1, 0), (1, 1))
    corners = [own[i + a, j + b] for a, b in sides]
    half = [on & (np.abs(y - 3 * a) + np.abs(x - 3 * b) < 3) for on, (a, b) in zip(corners, sides, strict=True)]
    return tri[(np.sum(corners, axis=0) > 1) | np.any(half, axis=0)]


def _in_bay(path: np.ndarray, scale: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Triangles on the outer side of a stretch of the outer boundary (clockwise) that begins and ends at the hull."""
    cells, at = np.unique(path, axis=0, return_inverse=True)
    made = _around(cells, scale, middle)
    if not len(made):
        return made
    tri = np.searchsorted(cells[:, 0] * (1 << 31) + cells[:, 1], made[..., 0] * (1 << 31) + made[..., 1]).tolist()
    edge = {(t[i - 1], t[i]): k for k, t in enumerate(tri) for i in range(3)}
    steps = list(zip(at.ravel()[1:].tolist(), at.ravel()[:-1].tolist(), strict=True))
    walls = {*steps, *((b, a) for a, b in steps)}
    todo, inside = [edge[x] for x in steps if x in edge], np.zeros(len(tri), bool)
    while todo:
        if not inside[k := todo.pop()]:
            inside[k], t = True, tri[k]
            todo += [edge[t[i], t[i - 1]] for i in range(3) if (t[i - 1], t[i]) not in walls and (t[i], t[i - 1]) in edge]
    return made[inside]


def _on_hull(path: np.ndarray) -> np.ndarray:
    """Whether cells of an outer boundary lie on the rim of the convex hull, between its corners too."""
    r, c = path[:, 0] - path[:, 0].min(), path[:, 1]
    out = (r == 0) | (r == r.max())
    for x in (c, -c):
        first = np.full(r.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, r, x)
        v, ends = first.tolist(), []
        for i, y in enumerate(v):
            while len(ends) > 1 and (v[ends[-1]] - v[ends[-2]]) * (i - ends[-2]) >= (y - v[ends[-2]]) * (ends[-1] - ends[-2]):
                ends.pop()
            ends.append(i)
        ends = np.array(ends)
        b = ends[np.searchsorted(ends, r)]
        a = ends[np.maximum(np.searchsorted(ends, r) - 1, 0)]
        out |= (x == first[r]) & ((first[b] - first[a]) * (r - a) == (x - first[a]) * (b - a))
    return out


def cell_boundary(mask: np.ndarray, dx: float, dy: float, r0: int = 0, c0: int = 0, shrink: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """x and y of ``alpha_boundary`` of all set cells' middles.

    A square of four set cells is made of triangles, whatever lies around it, so that only what lies between squares is
    triangulated, gap by gap; squares that share sides are one piece from the start.
    """
    m, n = mask.shape
    c, r = np.nonzero(mask.T)
    every = np.stack(((c + c0 + 1) * dx, (r + r0 + 1) * dy), axis=1).astype(float)
    square = np.zeros((m + 1, n + 1), bool)  # at (i, j) the one between rows i - 1 and i, columns j - 1 and j
    square[1:-1, 1:-1] = mask[:-1, :-1] & mask[1:, :-1] & mask[:-1, 1:] & mask[1:, 1:]
    inner = square[:-1, :-1] & square[1:, :-1] & square[:-1, 1:] & square[1:, 1:]
    on_rim = ~inner[r, c]
    r, c, points = r[on_rim], c[on_rim], every[on_rim]
    number = np.full((m, n), -1)
    number[r, c] = np.arange(len(r))
    tri = gap_triangles(mask, dx, dy)
    if tri is None:
        tri = delaunay(points, every)
        if len(tri):
            tri = tri[~square[r[tri].sum(1) // 3 + 1, c[tri].sum(1) // 3 + 1]]
    else:
        tri = number[tri[..., 0], tri[..., 1]]
    piece, pieces = parts(square, False)
    around = lambda: points[[{tuple(p): i for i, p in reversed(list(enumerate(points.tolist())))}[q] for q in hull([tuple(p) for p in points.tolist()])]].T
    if not len(tri) and not pieces:
        return tuple(around())
    radius, k = _radii(points, tri), len(tri)
    # the other side of each edge: a triangle, a piece of squares (after the triangles) or nothing
    u, v = tri.ravel(), np.roll(tri, -1, axis=1).ravel()
    code, back = u * len(points) + v, v * len(points) + u
    order = np.argsort(code)
    at = np.minimum(np.searchsorted(code, back, sorter=order), max(0, 3 * k - 1))
    other = np.where(code[order[at]] == back, order[at] // 3, -1) if k else np.zeros(0, int)
    dr, dc = r[v] - r[u], c[v] - c[u]
    beside = np.abs(dr) + np.abs(dc) == 1
    facing = np.where(beside, piece[np.where(beside, r[u] + ((dc < 0) | (dr > 0)), 0), np.where(beside, c[u] + ((dr > 0) | (dc > 0)), 0)], -1)
    other = np.where((other < 0) & (facing >= 0), facing + k, other)
    covered = np.zeros(len(points), bool)
    covered[(square[:-1, :-1] | square[1:, :-1] | square[:-1, 1:] | square[1:, 1:])[r, c]] = True
    seen, missing, left = covered.tolist(), int((~covered).sum()), pieces
    parent, on = list(range(k + pieces)), [False] * k + [True] * pieces
    finite, unit = np.isfinite(radius), float(np.hypot(dx, dy)) / 2
    least = unit if left == 1 and not missing else None
    near = other.reshape(-1, 3)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in [] if least is not None else np.argsort(radius, kind="stable").tolist():
        if not finite[i]:
            break
        on[i], left = True, left + 1
        for p in tri[i].tolist():
            if not seen[p]:
                seen[p], missing = True, missing - 1
        for j in near[i].tolist():
            if j >= 0 and on[j] and (a := find(j)) != (b := find(i)):
                parent[a], left = b, left - 1
        if left == 1 and not missing:
            least = radius[i]
            break
    if least is None:
        return tuple(around())
    most = float(np.max(np.append(radius[finite], [unit] * bool(pieces))))
    keep = radius <= least + (1 - shrink) * (most - least) + 1e-12
    stays = np.append(np.concatenate((keep, np.ones(pieces, bool))), False)  # last: nothing
    mine = np.repeat(keep, 3)
    rim = mine & ~stays[other]
    nxt: dict[int, list[int]] = {}
    for a, b in zip(u[rim].tolist(), v[rim].tolist(), strict=True):
        nxt.setdefault(a, []).append(b)
    i, j = np.nonzero(square)
    taken = np.sort(back[mine & (other >= k)])
    for a, b, bare in (((0, 0), (0, 1), (-1, 0)), ((0, 1), (1, 1), (0, 1)), ((1, 1), (1, 0), (1, 0)), ((1, 0), (0, 0), (0, -1))):
        open_ = ~square[i + bare[0], j + bare[1]]
        p, q = (number[i[open_] - 1 + x[0], j[open_] - 1 + x[1]] for x in (a, b))
        free = ~np.isin(p * len(points) + q, taken)
        for a_, b_ in zip(p[free].tolist(), q[free].tolist(), strict=True):
            nxt.setdefault(a_, []).append(b_)
    loop = _longest(points, nxt)
    return tuple(points[loop].T) if loop else tuple(around())


def wedges(path: np.ndarray, x: np.ndarray, y: np.ndarray, depth: np.ndarray, slide: float, centre: tuple[float, float], phi: float) -> dict[str, np.ndarray]:
    """Wedge prisms between consecutive boundary cells: direction, gradient, inner and outer width, reach, volume."""
    n = len(path)
    bearing = np.degrees(np.arctan2(y - centre[1], x - centre[0])) % 360
    angle = np.radians(pressure_angle((bearing - slide) % 360, phi))
    reach = depth * np.cos(angle) / np.sin(angle)
    fall = np.divide(depth, reach, out=np.zeros(n), where=reach != 0)
    px, py, nx, ny = np.roll(x, 1), np.roll(y, 1), np.roll(x, -1), np.roll(y, -1)
    to_next, to_prev = np.degrees(np.arctan2(ny - y, nx - x)) % 360, np.degrees(np.arctan2(py - y, px - x))
    turn = (to_prev - to_next) % 360
    ray = to_next + turn / 2 + 180
    ox, oy = x + reach * np.cos(np.radians(ray)), y + reach * np.sin(np.radians(ray))
    area = depth * reach / 2
    mean = lambda v: (v + np.roll(v, -1)) / 2
    inner, outer = np.hypot(nx - x, ny - y), np.hypot(np.roll(ox, -1) - ox, np.roll(oy, -1) - oy)
    width = (inner + outer) / 2
    # a prism's bearing is the plain mean of its ends' bearings from the centre, without wrapping
    return {"ray": ray, "direction": mean(bearing), "fall": mean(fall), "inner": inner, "outer": outer, "width": width, "reach": mean(reach), "volume": mean(area) * width, "prism": to_next}


def direction(dy: float, dx: float) -> float:
    return math.degrees(math.atan2(dy, dx)) % 360
