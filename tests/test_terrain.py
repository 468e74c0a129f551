"""Operators of the terrain engine against brute force on small grids, and invariants."""

import heapq
import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import focal, geometry, grid, growth, hillslope, hydrology, labels, morphology, scenarios, vector, zonal

SIDES = list(grid.SIDES.values())


def table(spark, z, name="z", kind="double"):
    rows = [(r, c, None if z[r][c] is None or z[r][c] != z[r][c] else {"double": float, "int": int}.get(kind, bool)(z[r][c])) for r in range(len(z)) for c in range(len(z[0]))]
    return spark.createDataFrame(rows, f"r int, c int, {name} {kind}")


def array(df, name, shape, kind=float):
    out = np.full(shape, np.nan if kind is float else False, dtype=kind)
    for r in df.select("r", "c", name).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


def random_grid(seed, m=9, n=11, holes=True):
    g = np.random.default_rng(seed)
    z = np.round(g.random((m, n)) * 8) + 100
    if holes:
        z[g.random((m, n)) < 0.06] = np.nan
    return z


def mask_of(seed, m=12, n=12, p=0.5):
    return np.random.default_rng(seed).random((m, n)) < p


def around(m, n, r, c):
    return [(r + a, c + b) for a, b in SIDES if 0 <= r + a < m and 0 <= c + b < n]


def union_labels(mask, four=False):
    m, n = mask.shape
    out, left = {}, {(r, c) for r in range(m) for c in range(n) if mask[r, c]}
    while left:
        start = min(left, key=lambda p: (p[1], p[0]))
        todo, root = [start], start[1] * m + start[0] + 1
        left.remove(start)
        while todo:
            r, c = todo.pop()
            out[r, c] = root
            for p in around(m, n, r, c):
                if p in left and not (four and abs(p[0] - r) + abs(p[1] - c) == 2):
                    left.remove(p)
                    todo.append(p)
    return out


def test_horn_by_hand(spark):
    df = table(spark, [[1, 2, 4], [2, 3, 5], [3, 5, 9]])
    mid = focal.horn(df, dx=1, dy=1).where("r = 1 and c = 1").first()
    assert mid.dzdx == pytest.approx(((4 + 10 + 9) - (1 + 4 + 3)) / 8) and mid.dzdy == pytest.approx(((3 + 10 + 9) - (1 + 4 + 4)) / 8)
    assert focal.horn(df).where("r = 0").agg(F.max("slope")).first()[0] == 0.0
    assert focal.horn(table(spark, [[1.0, 2.0]])).agg(F.max(F.abs("dzdx"))).first()[0] == 0.0


def ring_groups(h):
    ring = [("nw", 0, 0), ("n", 0, 1), ("ne", 0, 2), ("w", 1, 0), ("e", 1, 2), ("sw", 2, 0), ("s", 2, 1), ("se", 2, 2)]
    left = {(r, c) for s, r, c in ring if h[s]}
    k = 0
    while left:
        k, todo = k + 1, [left.pop()]
        while todo:
            r, c = todo.pop()
            for p in [p for p in left if max(abs(p[0] - r), abs(p[1] - c)) == 1]:
                left.remove(p)
                todo.append(p)
    return k


def test_bridge_rule_on_all_codes():
    want = morphology.build_lut(lambda h: h[""] or ring_groups(h) >= 2)
    assert want == morphology.LUTS["bridge"][0]


def test_chain_equals_single_passes(spark):
    df = table(spark, mask_of(3).tolist(), "mask", "boolean")
    steps = [("spur", 1), ("bridge", 1), ("majority", 1), ("diag", 1)]
    one = df
    for op, _ in steps:
        one = morphology.once(one, op)
    assert (array(morphology.chain(df, steps, size=8), "mask", (12, 12), bool) == array(one, "mask", (12, 12), bool)).all()


def test_skeleton_is_stable_and_tiles_do_not_matter(spark):
    df = table(spark, mask_of(5, 20, 20, 0.7).tolist(), "mask", "boolean")
    a = array(morphology.until_stable(df, "skel", block=2, size=8), "mask", (20, 20), bool)
    b = array(morphology.until_stable(df, "skel", block=8), "mask", (20, 20), bool)
    assert (a == b).all()
    again = a
    for lut in morphology.LUTS["skel"]:
        again = morphology.run_pass(again, lut)
    assert (again == a).all()


@pytest.mark.parametrize("four", [False, True])
def test_components(spark, four):
    mask = mask_of(7, p=0.45)
    got = {(r.r, r.c): r.root for r in labels.components(table(spark, mask.tolist(), "mask", "boolean"), connectivity=4 if four else 8).collect()}
    assert got == union_labels(mask, four)


def test_area_open_and_clear_border(spark):
    mask = mask_of(9, p=0.4)
    df, lab = table(spark, mask.tolist(), "mask", "boolean"), union_labels(mask)
    size = {k: list(lab.values()).count(k) for k in lab.values()}
    opened = array(labels.area_open(df, 4), "mask", mask.shape, bool)
    assert all(opened[p] == (size[k] >= 4) for p, k in lab.items()) and opened.sum() == sum(size[k] >= 4 for k in lab.values())
    rim = {k for (r, c), k in lab.items() if r in (0, 11) or c in (0, 11)}
    clear = array(labels.clear_border(df), "mask", mask.shape, bool)
    assert all(clear[p] == (k not in rim) for p, k in lab.items())


def priority_flood(z):
    m, n = z.shape
    out, heap = np.full(z.shape, np.inf), []
    for r in range(m):
        for c in range(n):
            if not math.isnan(z[r, c]) and (r in (0, m - 1) or c in (0, n - 1) or any(math.isnan(z[p]) for p in around(m, n, r, c))):
                out[r, c] = z[r, c]
                heapq.heappush(heap, (z[r, c], r, c))
    while heap:
        h, r, c = heapq.heappop(heap)
        for p in around(m, n, r, c):
            if not math.isnan(z[p]) and max(z[p], h) < out[p]:
                out[p] = max(z[p], h)
                heapq.heappush(heap, (out[p], *p))
    return np.where(np.isnan(z), np.nan, out)


def test_fill_and_accumulation(spark):
    z = random_grid(11)
    df = table(spark, z.tolist())
    filled = array(hydrology.fill_depressions(df), "filled", z.shape)
    assert np.array_equal(filled, priority_flood(z), equal_nan=True)
    flow = hydrology.flow_accumulation(hydrology.flow_direction(df))
    rows = {r.idx: r for r in flow.collect()}
    want = dict.fromkeys(rows, 0)
    for i in rows:
        at = i
        for _ in range(len(rows) + 1):
            want[at] += 1
            if rows[at].recv is None:
                break
            at = rows[at].recv
        else:
            raise AssertionError("a loop")
    assert all(rows[i].acc == want[i] for i in rows)
    assert sum(r.acc for r in rows.values() if r.recv is None) == len(rows)
    assert all(r.recv is None or rows[r.recv].filled <= r.filled for r in rows.values())


def test_flow_modes(spark):
    df = table(spark, random_grid(2, 6, 6, False).tolist())
    for mode in ("fill", "none"):
        assert hydrology.flow_direction(df, preprocess=mode).count() == 36
    with pytest.raises(ValueError):
        hydrology.flow_direction(df, preprocess="other")


def test_soil_depth_halos(spark):
    z = random_grid(13, 14, 14) * 1.0
    df = table(spark, z.tolist())
    a = array(hillslope.soil_depth(df, -495.0, block=2, size=8), "depth", z.shape)
    rim = np.ones(z.shape, bool)
    rim[1:-1, 1:-1] = False
    s, rock = z, z - 1
    for _ in range(hillslope.steps(-495.0)):
        s, rock = hillslope.step(s, rock, rim, 10.0)
    assert np.allclose(a, s - rock, equal_nan=True)
    assert hillslope.steps(5000) == 5501


def test_polygons(spark):
    x, y = np.array([0.0, 4, 4, 0]), np.array([0.0, 0, 3, 3])
    assert geometry.measures(x, y) == pytest.approx((12, 2, 1.5, 14))
    assert geometry.trace({(0, 0), (0, 1), (1, 0), (1, 1)}) == [(0, 0), (0, 1), (1, 1), (1, 0)]
    assert geometry.trace({(2, 2)}) == [(2, 2)] and geometry.trace(set()) == []
    ring = {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}
    assert [len(k) for k in vector.rings(ring)] == [4, 4]
    pts = np.array([(i, j) for i in range(5) for j in range(5)], float)
    assert len(geometry.delaunay(pts)) == 32
    loop = geometry.alpha_boundary(pts)
    assert geometry.measures(pts[loop, 0], pts[loop, 1])[0] == pytest.approx(16)
    df = table(spark, [[1, 1, 2], [1, 0, 2], [3, 1, 2]], "unit", "int")
    got = {(r.unit, r.part): (r.n_cells, r.geometry) for r in vector.outlines(df).collect()}
    assert got[1, 1][0] == 3 and got[1, 2][0] == 1 and got[2, 1][1].startswith("POLYGON ((")
    assert vector.to_geojson(vector.union_by_unit(vector.outlines(df))).count() == 3


def test_partition_metrics_of_equal_partitions(spark):
    df = table(spark, [[1, 1, 2, 2]] * 4, "a", "int").withColumn("b", F.col("a") + 5)
    t = zonal.contingency(df)
    assert zonal.adjusted_rand(t).first()[0] == 1 and zonal.variation_of_information(t).first()[0] == 0
    assert tuple(zonal.best_iou(t).first()) == (1, 1) and zonal.boundary_fscore(df).first().f == 1


def test_scenarios(spark):
    g = table(spark, [[1.0, 2.0]])
    slides = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (2, 0, 1), (4, 0, 1)], "run int, r int, c int")
    summary = spark.createDataFrame([(1, 0.5, 1), (2, 0.25, 2), (3, 0.25, 0), (4, 0.0, 1)], "run int, prob double, n_clusters long")
    assert array(scenarios.susceptibility(slides, summary, g), "sus", (1, 2)).tolist() == [[75.0, 25.0]]
    bank = spark.createDataFrame([(1, 0, 0, 0.5, 2, False)], "run int, r int, c int, prob double, n_runs int, no_slides boolean")
    assert [tuple(r) for r in scenarios.contribution_gaps(bank, 2).collect()] == [(2, "missing")]
    with pytest.raises(ValueError):
        scenarios.aggregate_contributions(bank, g, 2)


def test_growth_parts():
    mask = np.zeros((7, 7), bool)
    mask[2:5, 2:5] = True
    z = np.add.outer(np.arange(7.0), np.zeros(7))
    ring, edge = growth.downhill(mask, 10 - z)
    assert not edge and ring and all(r == 5 for r, _ in ring)
    assert growth.spur([(0, 0)]) == 6 and growth.spur([]) == 0 and growth.spur([(0, 0), (1, 0), (2, 0)]) == 2 and growth.single(mask)
    assert growth.greedy(-3.0, 0.0, 3.0, 10.0, [1.0, 2.0, 5.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]) in ([0, 1], [0])


def test_empty_grid(spark):
    df = spark.createDataFrame([], "r int, c int, z double, mask boolean")
    assert focal.horn(df).count() == 0 and labels.components(df).count() == 0 and hydrology.fill_depressions(df).count() == 0
    assert grid.misaligned(df, df).count() == 0


def test_growth_queries_run_all_strengths_to_the_end(spark, sf, monkeypatch):
    from talus.catalog import QUERIES
    from talus.plans import regional
    from talus.queries.fixtures import RUNS

    seen = []

    def whole(df, runs, settings=None, **options):
        seen.append((sorted(r.run for r in runs.collect()), settings or growth.Settings()))
        return {"clusters": spark.createDataFrame([(1, 1, 0, 0, "final", 0, 1)], "run int, cluster long, r int, c int, kind string, code int, cycles int")}

    monkeypatch.setattr(regional, "regional", whole)
    for name in ("cluster_growth", "termination_histogram"):
        assert QUERIES[name](spark, sf).count()
    assert seen == [([r[0] for r in RUNS], growth.Settings())] * 2


def test_soil_depth_query_runs_to_the_default_end(spark, sf, monkeypatch):
    from talus.catalog import QUERIES

    seen = []

    def whole(df, endtime=inspect.signature(hillslope.soil_depth).parameters["endtime"].default):
        seen.append(hillslope.steps(endtime))
        return df.withColumn("depth", F.lit(1.0))

    monkeypatch.setattr(hillslope, "soil_depth", whole)
    assert QUERIES["soil_depth"](spark, sf).columns == ["r", "c", "depth"] and seen == [5501]


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_of_graphs(spark, few):
    from talus.plans.components import components as linked

    rng = np.random.default_rng(12)
    for n, m in ((1, 1), (40, 30), (60, 20), (30, 200)):
        edges = rng.integers(0, n, (m, 2)).tolist()
        parent = list(range(n))

        def find(x):
            while parent[x] != x:  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        got = {r.node: r.root for r in linked(spark.createDataFrame(edges, "a long, b long"), few).collect()}
        assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert linked(chain, few).where("root <> 0").count() == 0 and linked(chain.limit(0), few).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_accumulation_over_tiles(spark, few, monkeypatch):
    monkeypatch.setattr(hydrology, "TILE", 4)
    rng = np.random.default_rng(14)
    for m, n in ((1, 1), (9, 13), (14, 6)):
        z = rng.random((m, n)).round(2)
        df = spark.createDataFrame([(r, c, float(z[r, c]) if (r, c) != (3, 3) else None) for r in range(m) for c in range(n)], "r int, c int, z double")
        flow = hydrology.flow_direction(df).withColumn("own", F.col("r") + 2.0 * F.col("c") + 1)
        rows = {x.idx: x for x in flow.collect()}
        want = dict.fromkeys(rows, 0.0)
        for i, x in rows.items():
            at = i
            while at is not None:
                want[at] += x.own
                at = rows[at].recv
        got = {x.idx: x.acc for x in hydrology.flow_accumulation(flow, "own", few).collect()}
        assert got == pytest.approx(want)


class SlowGrowth:
    """The growth of one cluster, step by step over dictionaries of cells; outlines and wedges are the operator's."""

    def __init__(self, g, initial, phi, coh, s):
        self.g, self.s, self.phi, self.coh = g, s, phi, coh
        self.initial = sorted(initial, key=lambda p: (p[1], p[0]))
        self.m, self.n = g["z"].shape

    def sides(self, p):
        return [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]

    def whole(self, cells):
        seen, todo = set(), list(cells)[:1]
        while todo:
            p = todo.pop()
            if p in cells and p not in seen:
                seen.add(p)
                todo += self.sides(p)
        return bool(cells) and len(seen) == len(set(cells))

    def spur(self, cells):
        cells = sorted(cells, key=lambda p: (p[1], p[0]))
        if len(cells) < 2:
            return 6 * len(cells)
        steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(cells, cells[1:], strict=False)]
        return sum([len({c for _, c in cells}) == 1, len({r for r, _ in cells}) == 1, *(all(d[i] == v for d in steps) for i in (0, 1) for v in (1, -1))])

    def erode(self, cells):
        z = self.g["z"]
        out = set(cells)
        for p in cells:
            if any(q not in cells for q in self.sides(p)) and all(z[p] < z[q] for q in self.sides(p) if q in cells):
                out.discard(p)
        return out

    def forces(self, cells):
        """Geometry and closure before the roots are taken off."""
        ordered = sorted(cells, key=lambda p: (p[1], p[0]))
        volume = sum(self.g["depth"][p] for p in ordered) * self.s.dx * self.s.dy
        mask = np.zeros((self.m, self.n), bool)
        for p in ordered:
            mask[p] = True
        self.k.geometry(mask, ordered, sum(self.g["w"][p] for p in ordered) / volume)

    def close(self, cells):
        rots = range(len(self.g["qx"]))
        self.ex = [sum(self.g["qx"][k][p] for p in cells) + self.k.wx for k in rots]
        self.ey = [sum(self.g["qy"][k][p] for p in cells) + self.k.wy for k in rots]
        self.err = [math.hypot(a, b) for a, b in zip(self.ex, self.ey, strict=True)]

    def roots(self):
        self.ex, self.ey = [x - self.k.rx for x in self.ex], [y + self.k.ry for y in self.ey]
        self.err = [e - self.k.roots for e in self.err]

    def run(self):
        errors, stored, offset = {}, {}, 0
        while True:
            offset += self.s.step
            rows, columns = zip(*self.initial, strict=True)
            box = max(0, min(rows) - offset), min(self.m - 1, max(rows) + offset), max(0, min(columns) - offset), min(self.n - 1, max(columns) + offset)
            got = self.once(errors, stored, box)
            if got != "wider":
                return got
            if offset >= self.s.max_offset:
                return growth.WINDOW_CAP, self.cycle, self.was, self.cells

    def once(self, errors, stored, box):
        first = set(self.initial)
        if self.spur(first) or not self.whole(first):
            return growth._SKIPPED, 0, self.initial, self.initial
        cells = self.erode(self.erode(first)) if self.s.erosions == 2 else first
        if len(cells) <= 7 or self.spur(cells) or not self.whole(cells):
            cells = first
        self.was = sorted(cells, key=lambda p: (p[1], p[0]))
        self.cells = list(self.was)
        self.k = growth._Cluster(self.g, 0, 0, self.phi, self.coh, self.s)
        try:
            self.forces(self.cells)
        except (ValueError, ZeroDivisionError, IndexError):
            return growth._SKIPPED, 0, self.initial, self.initial
        heavy = sum(self.g["w"][p] for p in self.cells)
        self.close(self.cells)
        if self.k.roots > max(self.err):
            self.cells, emptied = [], True
        else:
            self.roots()
            emptied = False
        if heavy + self.k.wedge_weight <= 0:
            return growth._SKIPPED, 0, self.initial, self.initial
        stored[0], errors[0] = list(self.cells), min(self.err) / (heavy + self.k.wedge_weight) * 100
        allowed, on, code, self.cycle, slot = self.s.tolerance / 100 * heavy, set(self.was), growth.CONVERGED, 0, 0
        while min(self.err) > allowed and not emptied:
            ring = {q for p in on for q in self.sides(p)} - on
            if any(not (box[0] < r < box[1] and box[2] < c < box[3]) for r, c in ring):
                return "wider"
            z = self.g["z"]
            found = sorted((p for p in ring if all(z[p] < z[q] for q in self.sides(p) if q in on)), key=lambda p: (p[1], p[0]))
            found = [p for p in found if not self.g["nogrow"][p] and not math.isnan(self.g["q0"][p])]
            if not found:
                code = growth.NO_CELLS
                self.cells = list(stored[min(errors, key=lambda i: (errors[i], i))])
            else:
                slot, self.cycle = slot + 1, self.cycle + 1
                rot = min(range(len(self.err)), key=lambda k: (self.err[k], k))
                ex, ey, total = self.ex[rot], self.ey[rot], heavy + self.k.wedge_weight
                tried, left, percent = [], list(found), [self.err[rot] / total * 100]
                while left:
                    p = min(left, key=lambda p: (math.hypot(ex - self.g["qx"][rot][p], ey - self.g["qy"][rot][p]), found.index(p)))  # noqa: B023
                    ex, ey, total = ex + self.g["qx"][rot][p], ey + self.g["qy"][rot][p], total + self.g["w"][p]
                    left.remove(p)
                    tried.append(p)
                    percent.append(math.hypot(ex, ey) / total * 100)
                tried = tried[: percent.index(min(percent))]
                if not tried or slot in errors and errors[slot - 1] < errors[slot]:
                    code = growth.NO_GAIN
                self.cells = self.cells + tried
            on, heavy = set(self.cells), sum(self.g["w"][p] for p in self.cells)
            if code != growth.NO_CELLS:
                try:
                    self.forces(self.cells)
                except (ValueError, ZeroDivisionError, IndexError):
                    return growth.NO_GEOMETRY, self.cycle, self.was, self.cells
            self.close(self.cells)
            self.roots()
            if slot <= self.s.cycles:
                stored[slot] = list(self.cells)
                if heavy + self.k.wedge_weight <= 0:
                    return growth.NO_WEIGHT, self.cycle, self.was, self.cells
                errors[slot] = min(self.err) / (heavy + self.k.wedge_weight) * 100
            allowed = self.s.tolerance / 100 * heavy
            if self.cycle >= self.s.cycles:
                self.cells = list(stored[min(errors, key=lambda i: (errors[i], i))])
                return growth.MAX_CYCLES, self.cycle, self.was, self.cells
            if code:
                break
        return code, self.cycle, self.was, self.cells


def test_growth_step_by_step():
    """Clusters of three kinds of terrain, with no-grow cells, cells without forces, few cycles and narrow windows."""
    ends = {}
    for seed in range(120):
        rng = np.random.default_rng(seed)
        m, n = 26, 24
        r, c = np.mgrid[0:m, 0:n]
        z = (300 - 6.0 * r + 2.0 * np.abs(c - 12) + rng.normal(0, 1.5, (m, n))) if seed % 3 == 0 else (rng.random((m, n)) * 20 + 4.0 * r) if seed % 3 == 1 else 200 + 0.4 * ((r - 13) ** 2 + (c - 12) ** 2) + rng.random((m, n))
        g = {"z": z, "w": rng.uniform(2000, 5000, (m, n)), "depth": rng.uniform(1, 3, (m, n)), "pga": np.zeros((m, n)), "sigma_w": rng.uniform(0, 9, (m, n))}
        g["qx0"], g["qy0"] = rng.normal(0, 400, (m, n)), rng.normal(900, 400, (m, n))
        g["q0"] = np.where(rng.random((m, n)) < 0.03, np.nan, np.hypot(g["qx0"], g["qy0"]))
        turns = np.radians(np.linspace(-20, 20, 8))
        away = np.where(rng.random((m, n)) < 0.5, -1.0, 1.0)
        g["qx"] = np.stack([(g["qx0"] * np.cos(t) - g["qy0"] * np.sin(t)) * away for t in turns])
        g["qy"] = np.stack([(g["qx0"] * np.sin(t) + g["qy0"] * np.cos(t)) * away for t in turns])
        g["nogrow"] = rng.random((m, n)) < 0.05
        rows, columns = (3, 4) if seed % 4 else (2, 9)
        initial = np.zeros((m, n), bool)
        initial[11 : 11 + rows, 9 : 9 + columns] = True
        initial &= rng.random((m, n)) < 0.95
        s = growth.Settings(cycles=1 if seed % 5 == 0 else 30, step=2, max_offset=2 if seed % 7 == 0 else 40, s_roots=10.0 if seed % 2 else 1.0)
        cells = [tuple(map(int, p)) for p in np.argwhere(initial)]
        code, cycles, was, final = growth.grow(g, initial, 100, 34.0, 4.0, s)
        want = SlowGrowth(g, cells, 34.0, 4.0, s).run()
        assert (code, cycles, sorted(map(tuple, was)), sorted(map(tuple, final))) == (want[0], want[1], sorted(want[2]), sorted(want[3])), seed
        ends[code] = ends.get(code, 0) + 1
    assert len(ends) >= 4, ends


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_over_tiles(spark, connectivity, monkeypatch):
    monkeypatch.setattr(labels, "TILE", 3)
    rng = np.random.default_rng(15)
    for m, n, share in ((1, 1, 1.0), (11, 10, 0.5), (8, 13, 0.75), (5, 5, 0.0)):
        on, kind = rng.random((m, n)) < share, rng.integers(0, 2, (m, n))
        df = spark.createDataFrame([(r, c, bool(on[r, c]), int(kind[r, c])) for r in range(m) for c in range(n)], "r int, c int, mask boolean, kind int")
        for same in (None, "kind"):
            want = {}
            for c in range(n):
                for r in range(m):
                    if on[r, c] and (r, c) not in want:
                        todo = [(r, c)]
                        while todo:
                            p = todo.pop()
                            if p in want:
                                continue
                            want[p] = c * m + r + 1
                            for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0), *(((1, 1), (1, -1), (-1, 1), (-1, -1)) if connectivity == 8 else ())):
                                q = (p[0] + a, p[1] + b)
                                if 0 <= q[0] < m and 0 <= q[1] < n and on[q] and (same is None or kind[q] == kind[p]):
                                    todo.append(q)
            got = {(x.r, x.c): x.root for x in labels.components(df, connectivity=connectivity, same=same).collect()}
            assert got == want


def _ragged(seed):
    """The largest component of a random mask with holes and arms."""
    rng = np.random.default_rng(seed)
    mask = rng.random(rng.integers(2, 30, 2)) < rng.choice([0.4, 0.6, 0.8, 0.9, 0.97])
    label, k = geometry.parts(mask)
    return label == np.bincount(label[mask]).argmax() if k else None


def test_outline_of_cells_as_of_all_points():
    """Cells inside full squares left out of the triangulation; boundary walk and components on arrays."""
    for mask in filter(lambda x: x is not None, map(_ragged, range(150))):
        cells = [tuple(map(int, p)) for p in np.argwhere(mask)]
        assert list(map(tuple, geometry.traced(mask))) == geometry.trace(set(cells)) and growth.single(mask)
        c, r = np.nonzero(mask.T)
        points = np.stack(((c + 6) * 10.0, (r + 4) * 10.0), axis=1)
        loop = geometry.alpha_boundary(points)
        x, y = geometry.cell_boundary(mask, 10.0, 10.0, 3, 5)
        assert len(x) == len(loop)
        if len(loop) > 2:
            assert geometry.measures(x, y) == pytest.approx(geometry.measures(points[loop, 0], points[loop, 1]))
    assert not growth.single(np.eye(3, dtype=bool)[:, [0, 2, 1]] & ~np.eye(3, dtype=bool)[::-1]) and not growth.single(np.zeros((2, 2), bool))


def test_growth_of_a_large_cluster(monkeypatch):
    """A cluster at the grid's edge, whose windows all end alike, is tried once, and only its rim is triangulated."""
    rng = np.random.default_rng(5)
    m, n = 90, 40
    g = {k: rng.uniform(1, 3, (m, n)) for k in ("w", "depth", "sigma_w")} | {"pga": np.zeros((m, n)), "nogrow": np.zeros((m, n), bool), "z": rng.random((m, n)) * 20 + 4.0 * np.arange(m)[:, None]}
    g["q0"] = g["qx0"] = g["qy0"] = np.full((m, n), 500.0)
    g["qx"] = g["qy"] = np.full((8, m, n), 500.0)
    initial = np.zeros((m, n), bool)
    initial[20:70, 1:39] = True
    seen, sizes, known, triangles = [], [], growth._Cluster.geometry, geometry.delaunay
    monkeypatch.setattr(growth._Cluster, "geometry", lambda self, mask, *a: seen.append(int(mask.sum())) or known(self, mask, *a))
    monkeypatch.setattr(geometry, "delaunay", lambda points, *a: sizes.append(len(points)) or triangles(points, *a))
    code, cycles, _, final = growth.grow(g, initial, 100, 34.0, 4.0, growth.Settings())
    assert (code, cycles, len(seen)) == (growth.WINDOW_CAP, 0, 1) and len(final) == seen[0] > 1500 and sizes[0] < 500


def test_soil_depth_in_stretches():
    """Many steps in one go, on flat, steep and holed ground, as step by step; halo rows give up two a step."""
    for seed, (m, n) in enumerate([(9, 7), (40, 64), (300, 70)]):
        rng = np.random.default_rng(seed)
        z = rng.random((m, n)) * (4, 12, 30)[seed] + np.arange(m)[:, None]
        z[rng.random((m, n)) < 0.02] = np.nan
        rim = np.ones(z.shape, bool)
        rim[1:-1, 1:-1] = False
        s, rock = z, z - 1
        for _ in range(4):
            s, rock = hillslope.step(s, rock, rim, 10.0)
        for top, bottom in ((0, 0), (8, 0), (0, 8)) if m > 30 else ((0, 0),):
            a, b = hillslope.advance(z, z - 1, rim, 10.0, 4, top, bottom)
            core = slice(top, m - bottom)
            assert np.allclose(a[core], s[core], equal_nan=True, rtol=1e-12, atol=1e-9) and np.allclose(b[core], rock[core], equal_nan=True, rtol=1e-12, atol=1e-9)


def test_growth_from_packed_tiles(spark):
    """Windows of packed tiles (with holes, no-grow cells, fields that are the same all over) grow as whole arrays with Spark's rotated forces do."""
    from talus.operators import physics
    from talus.plans import regional

    rng = np.random.default_rng(11)
    m, n = 30, 21
    z = 300 - 9.0 * np.arange(m)[:, None] + 2.0 * np.abs(np.arange(n) - 10) + rng.normal(0, 1.5, (m, n))
    z[(np.arange(m)[:, None] * 7 + np.arange(n) * 13) % 41 == 0] = np.nan
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(m) for c in range(n) if (r, c) != (29, 20)]
    cells = regional.prepared(spark.createDataFrame(rows, "r int, c int, z double")).withColumn("nogrow", (F.col("r") * 5 + F.col("c") * 3) % 19 == 0)
    runs = scenarios.strength(spark, [(1, 36.0, 4.0, 0.5), (2, 30.0, 2.0, 0.0), (3, 33.0, 3.0, 0.5)])
    boxes = {(1, 1): (12, 6, 3, 4), (1, 2): (9, 14, 4, 4), (3, 1): (11, 7, 4, 5)}
    strong = {1: (36.0, 4.0), 3: (33.0, 3.0)}
    own = [(run, k, r, c, *strong[run]) for (run, k), (r0, c0, h, w) in boxes.items() for r in range(r0, r0 + h) for c in range(c0, c0 + w)]
    clusters = spark.createDataFrame(own, "run int, cluster long, r int, c int, phi double, coh double")
    assert sorted(map(tuple, growth.unpacked(growth.packed(clusters, 4), 4).collect())) == sorted(own)
    s = growth.Settings(cycles=12, step=2, max_offset=12)
    got = {}
    for x in growth.grow_clusters(clusters, cells, s, tile=4, reach=2).collect():
        got.setdefault((x.run, x.cluster), {"ends": (x.code, x.cycles), "initial": set(), "eroded": set(), "final": set()})[x.kind].add((x.r, x.c))

    keys, fields = ["run", "r", "c"], {}
    base = regional.forces_by_run(cells, runs)
    turned = physics.project_slope(physics.with_rotations(base.select(*keys, "z", "w", "sigma_s", "pga", "subdx", "subdy", "phi", "coh")))
    turned = turned.drop("subdx", "subdy").withColumnsRenamed({"dx1": "subdx", "dy1": "subdy"})
    for x in physics.column_forces(turned, F.col("phi"), F.col("coh")).select(*keys, "rot_id", "qx", "qy").collect():
        for k in ("qx", "qy"):
            fields.setdefault((x.run, k), np.full((8, m, n), np.nan))[x.rot_id, x.r, x.c] = np.nan if x[k] is None else x[k]
    for x in base.collect():
        for k, v in {"z": x.z, "w": x.w, "depth": x.depth, "pga": x.pga, "sigma_w": x.sigma_w, "sigma_s": x.sigma_s, "subdx": x.subdx, "subdy": x.subdy, "q0": None if x.z is None else x.q, "qx0": x.qx, "qy0": x.qy}.items():
            fields.setdefault((x.run, k), np.full((m, n), np.nan))[x.r, x.c] = np.nan if v is None else v
        fields.setdefault((x.run, "nogrow"), np.zeros((m, n), bool))[x.r, x.c] = x.nogrow
    for (run, k), (r0, c0, h, w) in boxes.items():
        g = {name: v for (r, name), v in fields.items() if r == run}
        x, y = growth.turned({f: g[f].ravel() for f in growth._LOADS}, *strong[run], s)
        for mine, theirs in ((x, g["qx"]), (y, g["qy"])):
            there = ~np.isnan(theirs.reshape(8, -1)) & ~np.isnan(g["w"].ravel())
            np.testing.assert_allclose(mine[there], theirs.reshape(8, -1)[there], rtol=1e-9, atol=1e-7)
        initial = np.zeros((m, n), bool)
        initial[r0 : r0 + h, c0 : c0 + w] = True
        code, cycles, was, final = growth.grow(g, initial, 100, *strong[run], s)
        want = {"ends": (code, cycles), "initial": set(map(tuple, np.argwhere(initial).tolist())), "eroded": set(map(tuple, np.asarray(was).tolist())), "final": set(map(tuple, np.asarray(final).tolist()))}
        assert got[run, k] == want, (run, k)
    assert max(x["ends"][1] for x in got.values()) > 0


def test_gaps_are_triangulated_apart(monkeypatch):
    """Triangles of gaps and squares cover the hull, and no circle holds a cell, on ragged masks and cells that are not square."""
    for seed in (*range(60), 597, 1863):
        rng = np.random.default_rng(seed)
        mask = rng.random(rng.integers(2, 45, 2)) < rng.choice([0.4, 0.6, 0.8, 0.95])
        label, k = geometry.parts(mask)
        if not k:
            continue
        mask = label == np.bincount(label[mask]).argmax()
        scale = np.array((10.0, 7.0 if seed % 2 else 10.0))  # of rows and columns
        tri = geometry.gap_triangles(mask, scale[1], scale[0])
        points = (np.argwhere(mask) * scale)[:, ::-1]
        a, b, c = ((tri[:, i] * scale)[:, ::-1] for i in range(3))
        area = ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
        squares = (mask[1:, 1:] & mask[:-1, 1:] & mask[1:, :-1] & mask[:-1, :-1]).sum()
        hull = np.array(geometry.hull(list(map(tuple, points.tolist()))))
        assert (area > 0).all() and area.sum() + squares * scale.prod() == pytest.approx(geometry.measures(*hull.T)[0])
        flat = np.vstack((a, b, c))
        circle = geometry._circles(flat, np.arange(len(flat)).reshape(3, -1).T)
        assert not ((points[:, 0] - circle[:, :1]) ** 2 + (points[:, 1] - circle[:, 1:2]) ** 2 < circle[:, 2:] * (1 - 1e-9)).any()
    assert geometry.gap_triangles(np.eye(3, dtype=bool) & (np.arange(3) != 1), 10.0, 10.0) is None
    # a long cluster with bites in its sides and holes: what is triangulated does not grow with its length
    taken, triangles = [], geometry.delaunay
    monkeypatch.setattr(geometry, "delaunay", lambda points, *x: taken.append(len(points)) or triangles(points, *x))
    for m in (800, 3200):
        mask = np.ones((m, 20), bool)
        mask[::4, 0] = mask[2::8, -2:] = mask[3::5, 9] = mask[3::5, 11:13] = False
        loop = geometry.cell_boundary(mask, 10.0, 10.0)
        assert geometry.measures(*loop)[1] == pytest.approx(104, abs=2)
    assert max(taken) < 40 and sum(taken) < 1000


def test_few_points_are_triangulated_without_arrays(monkeypatch):
    """The same triangles in the same order as over arrays, for lattice points with many in line, and points at large."""
    arrays = []
    monkeypatch.setattr(geometry, "_circles", lambda p, tri, known=geometry._circles: arrays.append(len(tri)) or known(p, tri))
    for seed in range(40):
        rng = np.random.default_rng(seed)
        points = np.unique(rng.integers(0, (30, 9), (rng.integers(3, 150), 2)), axis=0) * np.array((7.0, 10.0)) if seed % 2 else rng.random((80, 2))
        few = geometry.delaunay(points)
        calls, arrays[:] = len(arrays), []
        with monkeypatch.context() as other:
            other.setattr(geometry, "_FEW", 0)
            assert np.array_equal(few, geometry.delaunay(points))
        assert calls < 5 and (len(points) < 10 or len(arrays) > len(points))
        arrays.clear()
