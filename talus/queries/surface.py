"""Stencils, physics and scenarios without iteration."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import focal, geometry, grid, morphology, physics, zonal
from talus.plans import regional
from talus.queries.fixtures import (
    CELLS, ENDS, HOLES, MASK, PADDED, STATE, UNITS, cells, forces_sql, holes, horn_sql, masked, near, padded, passes_sql, query, runs, runs_sql, units, with_sql,
)
from talus.streaming import contributions


def rounded(df, *keys, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


def r6(*names, digits=6):
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


LIVE = "live as (select * from runs where prob <> 0)"
BY_RUN = "sr as (select state.*, run, phi, coh, prob from state cross join live)"


def state(spark, d):
    return regional.prepared(cells(spark, d))


@query(with_sql(*STATE, runs_sql(), LIVE, BY_RUN, *forces_sql("f", "sr"), select="select run, count(z) as n, count(*) filter (z is not null and q > 0) as n_unstable, round(count(*) filter (z is not null and q > 0) / count(z), 6) as share from f group by run"))
def unstable_share_by_run(spark, d):
    """Share of cells that a scenario's strength does not hold."""
    on = F.col("z").isNotNull()
    bad = F.count_if(on & (F.col("q") > 0))
    return regional.forces_by_run(state(spark, d), runs(spark)).groupBy("run").agg(F.count("z").alias("n"), bad.alias("n_unstable"), F.round(bad / F.count("z"), 6).alias("share"))


@query(with_sql(CELLS, ENDS, PADDED, select="select r, c, round(z, 6) as z from padded"))
def dem_pad(spark, d):
    return padded(spark, d).select("r", "c", F.round("z", 6).alias("z"))


@query(with_sql(CELLS, HOLES, select="select r, c, round(z, 6) as z, (c * (select max(r) + 1 from cells) + r + 1)::bigint as idx from holes where z is not null"))
def valid_cells(spark, d):
    h = holes(spark, d)
    return h.where("z is not null").select("r", "c", F.round("z", 6).alias("z"), grid.idx(grid.extent(h)[0]).alias("idx"))


@query(with_sql(CELLS, select="select r, c, case when 40 * v >= 0 and v <> 0.5 then round(40 * v, 6) end as z from cells"))
def read_rule(spark, d):
    """Values below zero, and the no-data value, become null when a raster is read."""
    return cells(spark, d).withColumn("z", 40 * F.col("v")).select("r", "c", F.round(grid.read_rule("z", 20.0), 6).alias("z"))


@query(with_sql(CELLS, ENDS, HOLES, *horn_sql("h", "holes"), select=f"select r, c, {r6('dzdx', 'dzdy', 'slope', 'aspect')} from h"))
def horn_gradient(spark, d):
    return rounded(focal.horn(holes(spark, d)).select("r", "c", "dzdx", "dzdy", "slope", "aspect"), "r", "c")


_CENTRAL = [
    near("gn", "cells", "z", sides={"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1)}),
    """grad as (select r, c, z, mr, mc, case when c = 0 then (z_e - z) / 10.0 when c = mc then (z - z_w) / 10.0 else (z_e - z_w) / 20.0 end as gx,
      case when r = 0 then (z_s - z) / 10.0 when r = mr then (z - z_n) / 10.0 else (z_s - z_n) / 20.0 end as gy from gn, ends)""",
]


@query(with_sql(CELLS, ENDS, *_CENTRAL, select=f"select r, c, {r6('gx', 'gy')} from grad"))
def central_gradient(spark, d):
    return rounded(focal.central_gradient(cells(spark, d)).select("r", "c", "gx", "gy"), "r", "c")


@query(with_sql(CELLS, ENDS, *_CENTRAL,
    "s1 as (select *, atan(sqrt(gx * gx + gy * gy)) as t, case when atan2(gx, gy) < pi() then atan2(gx, gy) + pi() / 2 else atan2(gx, gy) end as a0 from grad)",
    "s2 as (select *, case when a0 < 0 then a0 + 2 * pi() else a0 end as a from s1)",
    "s3 as (select *, 256.0 * (cos(radians(45.0)) * cos(t) + sin(radians(45.0)) * sin(t) * cos(radians(135.0) - a)) as x from s2)",
    select="select r, c, case when r > 0 and c > 0 and r < mr and c < mc then round(greatest(x, 0), 6) end as shade from s3"))
def hillshade(spark, d):
    return rounded(focal.hillshade(cells(spark, d)).select("r", "c", "shade"), "r", "c")


@query(with_sql(CELLS, ENDS,
    near("l1", "cells", "z", sides={"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1), "n2": (-2, 0), "s2": (2, 0), "w2": (0, -2), "e2": (0, 2)}),
    """l2 as (select *, case when c = 0 then z - 2 * z_e + z_e2 when c = mc then z - 2 * z_w + z_w2 end as h, case when r = 0 then z - 2 * z_s + z_s2 when r = mr then z - 2 * z_n + z_n2 end as k from l1, ends)""",
    select="select r, c, round(case when h is not null or k is not null then (coalesce(h, 0) + coalesce(k, 0)) / 200.0 else ((z_n + z_s + z_w + z_e) / 4 - z) / 100.0 end, 6) as lap from l2"))
def laplacian(spark, d):
    return rounded(focal.laplacian(cells(spark, d)).select("r", "c", "lap"), "r", "c")


_ALL = ["z", *(f"z_{k}" for k in grid.SIDES)]


@query(with_sql(CELLS, HOLES, near("g", "holes", "z"), select=f"select r, c, round(least({', '.join(_ALL)}), 6) as low, round(greatest({', '.join(_ALL)}), 6) as high from g"))
def grey_erosion_dilation(spark, d):
    return rounded(focal.dilation(focal.erosion(holes(spark, d))).select("r", "c", "low", "high"), "r", "c")


_BITS = ["mask", *(f"coalesce(mask_{k}, false)" for k in grid.SIDES)]
_SUM = " + ".join(f"coalesce(mask_{k}, false)::int" for k in grid.SIDES)
_M = [CELLS, ENDS, MASK, near("g", "mask", "mask"), f"k as (select *, {_SUM} as total from g)"]


@query(with_sql(*_M, select=f"select r, c, {' or '.join(_BITS)} as grown from k"))
def dilate3(spark, d):
    return focal.dilate(masked(spark, d)).select("r", "c", "grown")


@query(with_sql(*_M, select=f"select r, c, {' and '.join(_BITS)} as shrunk from k"))
def erode3(spark, d):
    return focal.erode(masked(spark, d)).select("r", "c", "shrunk")


@query(with_sql(*_M, select="select r, c, " + " + ".join(f"{w} * {'mask' if not s else f'coalesce(mask_{s}, false)'}::int" for s, w in focal.WEIGHTS.items()) + " as code from k"))
def neighbourhood_code(spark, d):
    return focal.code(masked(spark, d)).select("r", "c", "code")


_C = {k: f"coalesce(mask_{k}, false)" for k in grid.SIDES}
_STEPS = {
    "clean": "mask and total > 0",
    "fill": "mask or total = 8",
    "majority": "mask::int + total >= 5",
    "spur": "mask and total > 1",
    "diag": "mask or " + " or ".join(f"({_C[a]} and {_C[b]} and not {_C[a + b]})" for a in "ns" for b in "we"),
    # stretches of the ring, a corner between two set sides counting as set: their first cells are counted
    "bridge": "mask or " + " + ".join(f"({_C[k]} and not ({_C[p]} or {_C[q]}))::int" for k, p, q in (("n", "nw", "w"), ("e", "ne", "n"), ("s", "se", "e"), ("w", "sw", "s")))
    + " + " + " + ".join(f"({_C[k]} and not {_C[p]})::int" for k, p in (("ne", "n"), ("se", "e"), ("sw", "s"), ("nw", "w"))) + " >= 2",
}


def _register(op: str, rule: str) -> None:
    def run(spark, d):
        return morphology.once(masked(spark, d), op).select("r", "c", "mask")

    run.__name__ = f"morph_{op}"
    query(with_sql(*_M, select=f"select r, c, {rule} as mask from k") if rule else None)(run)


for _op, _rule in _STEPS.items():
    _register(_op, _rule)


@query(with_sql(CELLS, ENDS, MASK, *passes_sql("thin", "mask", [("skel", 40)]), select="select r, c, mask from thin"))
def morph_skeleton(spark, d):
    """Thinning until nothing changes; the grid's width bounds the passes that SQL states."""
    return morphology.until_stable(masked(spark, d), "skel").select("r", "c", "mask")


@query(with_sql(CELLS, UNITS, near("g", "units", "a", sides={"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1)}), select="select r, c, " + " or ".join(f"coalesce(a_{k} <> a, false)" for k in "nswe") + " as edge from g"))
def label_boundary(spark, d):
    return focal.label_boundary(units(spark, d), "a").select("r", "c", "edge")


@query(with_sql(*STATE, select=f"select r, c, {r6('hw', 'sigma_s', 'sigma_w', 'w', 'subdx', 'subdy')}, round(z - depth, 6) as z_sub from state"))
def hydrostatic_fields(spark, d):
    s = state(spark, d).withColumns({"hw": F.lit(1.0), "z_sub": F.col("z") - F.col("depth")})
    return rounded(s.select("r", "c", "hw", "sigma_s", "sigma_w", "w", "subdx", "subdy", "z_sub"), "r", "c")


@query(with_sql(CELLS, select="select r, c, 0.0::double as hw, 0.0::double as sigma_s, 0.0::double as sigma_w, round(16.0 * (1 + (r % 5) * 0.25) * 100.0, 6)::double as w from cells"))
def dry_fields(spark, d):
    x = physics.dry(cells(spark, d).withColumn("depth", 1 + (F.col("r") % 5) * F.lit(0.25)))
    return x.select("r", "c", "hw", "sigma_s", "sigma_w", F.round("w", 6).alias("w"))


@query(with_sql(CELLS, HOLES, select="select r, c, case when z is null then 0 else round(0.3 * 0.5, 6) end::double as pga, 0.0::double as off from holes"))
def pga_uniform(spark, d):
    return physics.pga_off(physics.pga_uniform(holes(spark, d), 0.3, 0.5).withColumnRenamed("pga", "p")).select("r", "c", F.round("p", 6).alias("pga"), F.col("pga").alias("off"))


@query(with_sql(CELLS, HOLES, select="select r, c, case when h.z is not null and x.v >= 0 then round(x.v * 2, 6) end as pga from holes h left join (select r, c, v from cells where c % 5 <> 0) x using (r, c)"))
def pga_raster_join(spark, d):
    raster = cells(spark, d).where("c % 5 <> 0").select("r", "c", F.col("v").alias("pga"))
    return physics.pga_raster(holes(spark, d), raster, 2.0).select("r", "c", F.round("pga", 6).alias("pga"))


_F = ("q", "qx", "qy", "area", "normal", "uplift", "alpha", "theta")


@query(with_sql(*STATE, "one as (select *, 36.0::double as phi, 4.0::double as coh from state)", *forces_sql("f", "one"), select=f"select r, c, {r6(*_F, digits=5)} from f"))
def column_forces(spark, d):
    return rounded(physics.column_forces(state(spark, d), 36.0, 4.0).select("r", "c", *_F), "r", "c", digits=5)


_ROT = ["rots as (select i as rot_id, -20.0 + 40.0 * i / 7 as rot from range(8) t(i))",
        """turned as (select s.r, s.c, s.z, s.w, s.sigma_s, s.pga, rot_id, rot, sqrt(subdx * subdx + subdy * subdy) * cos(radians(rot)) as len, degrees(atan2(subdy, subdx)) + rot as turn from state s cross join rots)""",
        "slopes as (select * exclude (len, turn), degrees(atan(len)) as slope1, len * cos(radians(turn)) as subdx, len * sin(radians(turn)) as subdy from turned)"]


@query(with_sql(*STATE, *_ROT, select="select r, c, rot_id, round(slope1, 6) + 0.0::double as slope1, round(subdx, 6) + 0.0::double as dx1, round(subdy, 6) + 0.0::double as dy1 from slopes"))
def slope_projection(spark, d):
    out = physics.project_slope(physics.with_rotations(state(spark, d)))
    return out.select("r", "c", "rot_id", *[(F.round(x, 6) + 0.0).alias(x) for x in ("slope1", "dx1", "dy1")])  # no negative zeros


@query(with_sql(*STATE, *_ROT, "one as (select *, 36.0::double as phi, 4.0::double as coh from slopes)", *forces_sql("f", "one"), select="select rot_id, count(*) as n, round(sum(qx), 3) as sum_qx, round(sum(qy), 3) as sum_qy from f group by rot_id"))
def column_forces_rotated(spark, d):
    out = physics.project_slope(physics.with_rotations(state(spark, d))).drop("subdx", "subdy").withColumnsRenamed({"dx1": "subdx", "dy1": "subdy"})
    f = physics.column_forces(out, 36.0, 4.0)
    return f.groupBy("rot_id").agg(F.count("*").alias("n"), F.round(F.sum("qx"), 3).alias("sum_qx"), F.round(F.sum("qy"), 3).alias("sum_qy"))


_PRISM = """wedge as (select r as id, 0.3 + abs(v) as subdx, 0.2 - v as subdy, 8.0 + r % 5 as width, 3.0 + c % 4 as reach, 120.0 + r as w, 30.0::double as phi, 2.0::double as coh, 5.0::double as press, 1.5 * v as kw from cells where c = 7)"""


@query(with_sql(CELLS, _PRISM,
    "w1 as (select *, sqrt(subdx * subdx + subdy * subdy) as m, atan(subdx) as ax, atan(subdy) as ay from wedge)",
    "w2 as (select *, atan(m) as a, width * reach * sqrt(1 - sin(ax) * sin(ax) * sin(ay) * sin(ay)) / (cos(ax) * cos(ay)) as area from w1)",
    "w3 as (select *, (w + press * area * sin(a) * tan(radians(phi)) - coh * area * sin(a)) / (cos(a) + sin(a) * tan(radians(phi))) as n from w2)",
    "w4 as (select *, n * sin(a) - (coh * area + (n - press * area) * tan(radians(phi))) * cos(a) + kw as q from w3)",
    select="select id, round(q, 6) as q, round(-subdx / m * q, 6) as qx, round(-subdy / m * q, 6) as qy from w4"))
def prism_forces(spark, d):
    v = F.col("v")
    w = cells(spark, d).where("c = 7").select(F.col("r").alias("id"), (0.3 + F.abs(v)).alias("gx"), (0.2 - v).alias("gy"), (8.0 + F.col("r") % 5).alias("width"), (3.0 + F.col("c") % 4).alias("reach"), (120.0 + F.col("r")).alias("w"), F.lit(30.0).alias("phi"), F.lit(2.0).alias("coh"), F.lit(5.0).alias("pressure"), (1.5 * v).alias("kw"))
    return rounded(physics.prism_forces(w).select("id", "q", "qx", "qy"), "id")


@query(with_sql(CELLS, UNITS, select="select a, b, count(*) as n from units where a > 0 and b > 0 group by a, b"))
def contingency(spark, d):
    return zonal.contingency(units(spark, d))


_T = [CELLS, UNITS, "t as (select a, b, count(*)::double as n from units where a > 0 and b > 0 group by a, b)", "ta as (select a, sum(n) as na from t group by a)", "tb as (select b, sum(n) as nb from t group by b)", "j as (select * from t join ta using (a) join tb using (b))"]


@query(with_sql(*_T, "s as (select (select sum(n * (n - 1) / 2) from t) as x, (select sum(na * (na - 1) / 2) from ta) as y, (select sum(nb * (nb - 1) / 2) from tb) as z, (select sum(n) from t) as n)", select="select round((x - y * z / (n * (n - 1) / 2)) / ((y + z) / 2 - y * z / (n * (n - 1) / 2)), 9) as ari from s"))
def adjusted_rand(spark, d):
    return zonal.adjusted_rand(zonal.contingency(units(spark, d))).select(F.round("ari", 9).alias("ari"))


@query(with_sql(*_T, select="select round(-sum(n / (select sum(n) from t) * (log2(n / na) + log2(n / nb))), 9) as vi from j"))
def variation_of_information(spark, d):
    return zonal.variation_of_information(zonal.contingency(units(spark, d))).select(F.round("vi", 9).alias("vi"))


@query(with_sql(*_T, "i as (select *, n / (na + nb - n) as iou from j)", select="select (select round(sum(best * size) / sum(size), 9) from (select max(iou) as best, max(na) as size from i group by a)) as iou_ab, (select round(sum(best * size) / sum(size), 9) from (select max(iou) as best, max(nb) as size from i group by b)) as iou_ba"))
def best_iou(spark, d):
    return rounded(zonal.best_iou(zonal.contingency(units(spark, d))), digits=9)


_X4 = {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1)}


@query(with_sql(CELLS, UNITS, near("g", "units", "a", "b", sides=_X4),
    "e as (select r, c, a > 0 and b > 0 and (" + " or ".join(f"coalesce(a_{k} <> a, false)" for k in "nswe") + ") as ea, a > 0 and b > 0 and (" + " or ".join(f"coalesce(b_{k} <> b, false)" for k in "nswe") + ") as eb from g)",
    near("w", "e", "ea", "eb", sides=_X4),
    "x as (select ea, eb, ea or " + " or ".join(f"coalesce(ea_{k}, false)" for k in "nswe") + " as wa, eb or " + " or ".join(f"coalesce(eb_{k}, false)" for k in "nswe") + " as wb from w)",
    "y as (select count(*) filter (ea and wb) / count(*) filter (ea) as p, count(*) filter (eb and wa) / count(*) filter (eb) as q from x)",
    select="select round(p, 9) as precision, round(q, 9) as recall, round(2 * p * q / (p + q), 9) as f from y"))
def boundary_fscore(spark, d):
    return rounded(zonal.boundary_fscore(units(spark, d)), digits=9)


@query(with_sql(CELLS, UNITS, select="select a as unit, count(*) as n_cells, count(*) * 100.0::double as area_m2 from units where a > 0 group by a"))
def unit_areas(spark, d):
    return zonal.unit_areas(units(spark, d).withColumnRenamed("a", "unit")).select("unit", "n_cells", "area_m2")


@query(with_sql(CELLS, HOLES, select="select (r // 25)::int as zone, count(z) as n, round(min(z), 6) as least, round(max(z), 6) as greatest, round(avg(z), 6) as mean, round(coalesce(sum(z), 0), 4) as total from holes group by 1"))
def zonal_statistics(spark, d):
    x = zonal.zonal(holes(spark, d).withColumn("zone", F.floor(F.col("r") / 25).cast("int")), "zone", "z")
    return x.select("zone", "n", F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"), F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"))


#: A map in percent, as a scenario sum would be: whole tenths between 0 and 100, null on the ring.
SUS = "sus as (select r, c, case when z is not null then greatest(0, floor((v + 0.1) * 2000) / 10.0) end as sus from padded)"


def sus(spark, d):
    return padded(spark, d).withColumn("sus", F.when(F.col("z").isNotNull(), F.greatest(F.lit(0.0), F.floor((F.col("v") + 0.1) * 2000) / 10.0)))


_S = [CELLS, ENDS, PADDED, SUS]


@query(with_sql(*_S, "k as (select count(sus) as n, count(*) filter (sus > 0) as n_pos, count(*) filter (sus >= 50) as n50, count(*) filter (sus >= 90) as n90, round(avg(sus), 6) as mean from sus)",
    select="select *, " + ", ".join(f"round(100.0 * {k} / n, 6) as {k}_share, round({k} * 0.0001::double, 9) as {k}_km2" for k in ("n_pos", "n50", "n90")) + " from k"))
def threshold_counts(spark, d):
    x = zonal.threshold_counts(sus(spark, d))
    return x.select("n", "n_pos", "n50", "n90", F.round("mean", 6).alias("mean"), *[F.round(f"{k}_{s}", 6 if s == "share" else 9).alias(f"{k}_{s}") for k in ("n_pos", "n50", "n90") for s in ("share", "km2")])


@query(with_sql(*_S, "p as (select sus from sus where sus > 0)", "e as (select min(sus) as lo, max(sus) as hi from p)", select="select least(50, floor((sus - lo) * 50 / (hi - lo)) + 1)::int as bin, count(*) as count from p, e group by 1"))
def histogram50(spark, d):
    return zonal.histogram(sus(spark, d))


@query(with_sql(*_S, select="select distinct sus as value, round(cume_dist() over (order by sus), 9) as share from sus where sus is not null"))
def empirical_cdf(spark, d):
    return rounded(zonal.empirical_cdf(sus(spark, d)), "value", digits=9)


@query(with_sql(*_S, select="select round(quantile_cont(sus, 0.5), 9) as p50, round(quantile_cont(sus, 0.9), 9) as p90 from sus"))
def percentiles(spark, d):
    return rounded(zonal.percentiles(sus(spark, d)), digits=9)


_POLY = "poly as (select (r // 8)::int as poly, r % 8 as seq, (10 + v) * cos(radians(45.0 * (r % 8))) as x, (10 + v) * sin(radians(45.0 * (r % 8))) as y from cells where c = 3)"


@query(with_sql(CELLS, _POLY,
    "p1 as (select *, coalesce(lead(x) over w, first_value(x) over w) as xn, coalesce(lead(y) over w, first_value(y) over w) as yn, count(*) over (partition by poly) as k from poly window w as (partition by poly order by seq))",
    "p2 as (select poly, max(k) as k, sum(x * yn - xn * y) / 2 as a, sum((x + xn) * (x * yn - xn * y)) as sx, sum((y + yn) * (x * yn - xn * y)) as sy, sum(sqrt((xn - x) * (xn - x) + (yn - y) * (yn - y))) as p, avg(x) as mx, avg(y) as my from p1 group by poly)",
    select="select poly, round(case when k >= 3 then abs(a) else 0 end, 6) as area, round(case when k >= 3 and a <> 0 then sx / (6 * a) else mx end, 6) as cx, round(case when k >= 3 and a <> 0 then sy / (6 * a) else my end, 6) as cy, round(case when k >= 3 then p else 0 end, 6) as perimeter from p2"))
def polygon_geometry(spark, d):
    a = F.radians(45.0 * (F.col("r") % 8))
    v = cells(spark, d).where("c = 3").select(F.floor(F.col("r") / 8).cast("int").alias("poly"), (F.col("r") % 8).alias("seq"), ((10 + F.col("v")) * F.cos(a)).alias("x"), ((10 + F.col("v")) * F.sin(a)).alias("y"))
    return rounded(geometry.polygon_measures(v), "poly")


@query(with_sql(CELLS, "t as (select r as id, v as ax, v * 2 + 1 as ay, v - 3 as bx, v * v as byy, 4 - v as cx, 2 - v as cy from cells where c = 9)",
    "u as (select *, sqrt((ax - bx) * (ax - bx) + (ay - byy) * (ay - byy)) as p, sqrt((cx - bx) * (cx - bx) + (cy - byy) * (cy - byy)) as q, sqrt((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy)) as s, abs((bx - ax) * (cy - ay) - (cx - ax) * (byy - ay)) as k from t)",
    select="select id, round(p * q * s / (2 * k), 6) as radius from u"))
def circumradius(spark, d):
    v = F.col("v")
    return cells(spark, d).where("c = 9").select(F.col("r").alias("id"), F.round(geometry.circumradius(v, v * 2 + 1, v - 3, v * v, 4 - v, 2 - v), 6).alias("radius"))


_ROOT = "b as (select (r // 20)::int as cluster, r % 20 as seq, (18.0 * (r % 20) + 30 * (r // 20)) % 360 as prism_dir, 2 + v as depth, 9.0 + r % 3 as width, (25.0 * (r // 20)) % 360 as slide_dir, r % 5 as burn from cells where c = 11)"


@query(with_sql(CELLS, _ROOT,
    "b1 as (select *, prism_dir + 270 - slide_dir as t, (depth + coalesce(lead(depth) over w, first_value(depth) over w)) / 2 as dd from b window w as (partition by cluster order by seq))",
    "b2 as (select cluster, max(slide_dir) as s, sum(case when (t > -270 and t < -90) or (t > 90 and t < 270) or (t > 450 and t < 630) then (case when burn >= 3 then 10.0 else 4.0 end) * dd * width * abs(cos(radians(t))) else 0 end) as force from b1 group by cluster)",
    select="select cluster, round(force, 6) as force, round(force * cos(radians(s)), 6) as fx, round(force * sin(radians(s)), 6) as fy from b2"))
def root_force(spark, d):
    r, k = F.col("r"), F.floor(F.col("r") / 20)
    b = cells(spark, d).where("c = 11").select(k.cast("int").alias("cluster"), (r % 20).alias("seq"), ((18.0 * (r % 20) + 30 * k) % 360).alias("prism_dir"), (2 + F.col("v")).alias("depth"), (9.0 + r % 3).alias("width"), ((25.0 * k) % 360).alias("slide_dir"), (r % 5).alias("burn"))
    return rounded(geometry.root_force(b, 10.0, 4.0), "cluster")


@query(with_sql("k as (select i / 2.0 as x from range(0, 721) t(i))",
    select="select round(x, 6) as direction, round(case when x <= 180 then 27.0 + 36.0 * x / 180 when x < 181 then 63.0 else 63.0 - 36.0 * (x - 181) / 179 end, 6) as angle from k"))
def pressure_angle(spark, d):
    x = spark.range(0, 721).select((F.col("id") / 2.0).alias("direction"))
    return rounded(x.withColumn("angle", geometry.pressure_angle(F.col("direction"), 36.0)), digits=6)


@query("""with l as (select event_id, case event_id % 5 when 0 then 'Found ' || user_id || ' candidate clusters' when 1 then '2026-01-02 03:04:05 [run ' || (event_id % 7 + 1) || '/10] phi' when 2 then 'LS Cluster ' || event_id % 90 || '/90' when 3 then 'PARALLEL progress: ' || (event_id % 40) / 4.0 || '/10' else event_type end as line from events),
  t as (select event_id, regexp_replace(line, '^\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d\\s+', '') as s from l)
  select event_id, case when regexp_matches(s, '^Found \\d+ candidate clusters') then 'clusters' when regexp_matches(s, '^\\[run \\d+/\\d+\\]') then 'run' when regexp_matches(s, '^LS Cluster \\d+/\\d+') then 'cluster' when regexp_matches(s, '^PARALLEL progress: [\\d.]+/\\d+') then 'parallel' end as event,
  case when event_id % 5 < 4 then regexp_extract(s, '([\\d.]+)', 1)::double end as first, case when event_id % 5 in (1, 2, 3) then regexp_extract(s, '/(\\d+)', 1)::double end as second from t""")  # fmt: skip
def progress_log_parse(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    line = (
        F.when(i % 5 == 0, F.concat(F.lit("Found "), "user_id", F.lit(" candidate clusters")))
        .when(i % 5 == 1, F.concat(F.lit("2026-01-02 03:04:05 [run "), i % 7 + 1, F.lit("/10] phi")))
        .when(i % 5 == 2, F.concat(F.lit("LS Cluster "), i % 90, F.lit("/90")))
        .when(i % 5 == 3, F.concat(F.lit("PARALLEL progress: "), (i % 40) / 4.0, F.lit("/10")))
        .otherwise(F.col("event_type"))
    )
    return contributions.parse_progress(e.select("event_id", line.alias("line"))).select("event_id", "event", "first", "second")


@query(with_sql(*_M, select="select r, c, not mask as only_a from k where (r + c) % 3 = 0 and not mask"))
def mask_difference(spark, d):
    a, b = masked(spark, d).where("(r + c) % 3 = 0").select("r", "c"), masked(spark, d).where("mask").select("r", "c")
    return a.exceptAll(b).withColumn("only_a", F.lit(True))


@query(with_sql(*STATE, runs_sql(), LIVE, BY_RUN, *forces_sql("f", "sr"), "n as (select distinct r, c from cells where v > 0.1)", select="select run, count(*) as n, round(sum(q), 3) as sum_q from f anti join n using (r, c) where z is not null and q > 0 group by run"))
def nogrow_antijoin(spark, d):
    no = cells(spark, d).where("v > 0.1").select("r", "c")
    f = physics.unstable(regional.forces_by_run(state(spark, d), runs(spark))).join(no, ["r", "c"], "left_anti")
    return f.groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("q"), 3).alias("sum_q"))

