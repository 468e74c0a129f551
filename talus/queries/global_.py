"""Labels, hydrology, hillslopes, growth and scenario maps."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from talus.operators import grid, growth, hillslope, hydrology, labels, morphology, physics, scenarios, vector, zonal
from talus.plans import regional
from talus.plans.checkpoints import cut
from talus.queries.fixtures import (
    BROKEN, CELLS, ENDS, HOLES, MASK, PADDED, RUNS, STATE, UNITS, cells, components_sql, forces_sql, holes, masked, near, passes_sql, query, runs, runs_sql, units, with_sql,
)
from talus.queries.surface import BY_RUN, LIVE, rounded, state

_L8 = [CELLS, ENDS, MASK, *components_sql("comp", "mask")]
_L4 = [CELLS, ENDS, MASK, *components_sql("comp", "mask", diagonal=False)]


def _sql(*ctes, select):
    return with_sql(*ctes, select=select, recursive=True)


@query(_sql(*_L8, select="select r, c, root from comp"))
def components8(spark, d):
    return labels.components(masked(spark, d)).select("r", "c", "root")


@query(_sql(*_L4, select="select r, c, root from comp"))
def components4(spark, d):
    return labels.components(masked(spark, d), connectivity=4).select("r", "c", "root")


@query(_sql(*_L8, select="select root, count(*) as cells from comp group by root"))
def component_sizes(spark, d):
    return labels.sizes(labels.components(masked(spark, d)))


@query(_sql(*_L8, select="select r, c, dense_rank() over (order by root) as label from comp"))
def relabel_compact(spark, d):
    return labels.numbered(labels.components(masked(spark, d))).select("r", "c", F.col("label").cast("long").alias("label"))


@query(_sql(*_L8, "big as (select root from comp group by root having count(*) >= 7)", select="select r, c, coalesce(root in (select root from big), false) as mask from mask m left join (select r, c, root from comp) using (r, c)"))
def area_open(spark, d):
    return labels.area_open(masked(spark, d), 7).select("r", "c", "mask")


@query(_sql(*_L8, "edge as (select distinct root from comp, ends where r = 0 or c = 0 or r = mr or c = mc)", select="select r, c, coalesce(root not in (select root from edge), false) as mask from mask m left join (select r, c, root from comp) using (r, c)"))
def clear_border(spark, d):
    return labels.clear_border(masked(spark, d)).select("r", "c", "mask")


#: Elevations in steps of 4, so that there are plateaus.
STEPPED = "stepped as (select r, c, z is not null as has, floor(z / 4) * 4 as z from holes)"


def stepped(spark, d):
    return holes(spark, d).select("r", "c", (F.floor(F.col("z") / 4) * 4).cast("double").alias("z"))


@query(_sql(CELLS, ENDS, HOLES, STEPPED, *components_sql("comp", "stepped", mask="has", same="z"), near("g", "stepped", "z"),
    f"bad as (select distinct root from comp join (select r, c from g where least({', '.join(f'z_{k}' for k in grid.SIDES)}) < z) using (r, c))",
    select="select r, c, coalesce(root not in (select root from bad), false) as minimum from stepped left join (select r, c, root from comp) using (r, c)"))
def regional_minima(spark, d):
    return labels.regional_minima(stepped(spark, d)).select("r", "c", "minimum")


_OFFSETS = ", ".join(f"({a}, {b})" for a in range(-2, 3) for b in range(-2, 3) if 0 < a * a + b * b <= 4)
_SEEDS = "seeds as (select r, c, (case when r % 7 = 0 and c % 5 = 0 then r // 7 * 100 + c // 5 + 1 else 0 end)::bigint as label, (r * 3 + c) % 11 <> 0 as room from cells)"


@query(with_sql(CELLS, _SEEDS, f"o as (select * from (values {_OFFSETS}) o(a, b))",
    "best as (select r, c, min({'d': d, 'l': label}) as x from (select s.r + a as r, s.c + b as c, a * a + b * b as d, label from seeds s cross join o where label > 0) group by r, c)",
    select="select r, c, case when label > 0 then label when room then coalesce(x.l, 0) else 0 end as label from seeds left join best using (r, c)"))
def expand_labels(spark, d):
    r, c = F.col("r"), F.col("c")
    s = cells(spark, d).select("r", "c", F.when((r % 7 == 0) & (c % 5 == 0), F.floor(r / 7) * 100 + F.floor(c / 5) + 1).otherwise(0).cast("long").alias("label"), ((r * 3 + c) % 11 != 0).alias("room"))
    return labels.expand_labels(s, 2).select("r", "c", "label")


@query(_sql(*_L8,
    "d as (select *, r - lag(r) over w as dr, c - lag(c) over w as dc from comp window w as (partition by root order by idx))",
    "s as (select root, count(*) as cells, (min(c) = max(c))::int + (min(r) = max(r))::int + coalesce(bool_and(dr = 1), true)::int + coalesce(bool_and(dr = -1), true)::int + coalesce(bool_and(dc = 1), true)::int + coalesce(bool_and(dc = -1), true)::int as spur from d group by root)",
    select="select * from s"))
def spur_score(spark, d):
    return labels.spur_score(labels.components(masked(spark, d)))


@query(_sql(*_L8, "k as (select r // 50 as cluster, root from comp)", select="select cluster::int as cluster, count(distinct root) = 1 as whole from k group by cluster"))
def cluster_continuity(spark, d):
    found = labels.components(masked(spark, d)).withColumn("cluster", F.floor(F.col("r") / 50).cast("int"))
    return labels.continuous(found)


_MOVES = ", ".join(str(x) for x in grid.SIDES.values())
_GAP = " or ".join(f"z_{k} is null" for k in grid.SIDES)
_FILL = [
    near("fn", "holes", "z"),
    f"fs as (select r, c, z, c::bigint * m + r + 1 as idx, r = 0 or c = 0 or r = mr or c = mc or {_GAP} as out from fn, ends where z is not null)",
    f"fe as (select a.idx as a, b.idx as b, b.z as z from fs a cross join (values {_MOVES}) o(dr, dc) join fs b on b.r = a.r + dr and b.c = a.c + dc)",
    """fl(idx, h) using key (idx) as (select idx, case when out then z else 'inf'::double end as h from fs
      union select e.b, min(greatest(e.z, l.h)) from fl l join fe e on e.a = l.idx join recurring.fl o on o.idx = e.b where greatest(e.z, l.h) < o.h group by e.b)""",
    "filled as (select holes.r, holes.c, holes.z, h as filled from holes left join fs on fs.r = holes.r and fs.c = holes.c left join fl on fl.idx = fs.idx)",
]


@query(_sql(CELLS, ENDS, HOLES, *_FILL, select="select r, c, round(filled, 6) as filled from filled"))
def fill_depressions(spark, d):
    return hydrology.fill_depressions(holes(spark, d)).select("r", "c", F.round("filled", 6).alias("filled"))


_FLATS = [
    *_FILL, near("gn", "filled", "filled"),
    f"flat as (select r, c, filled, coalesce(r > 0 and c > 0 and r < mr and c < mc and {' and '.join(f'filled_{k} is not null and filled_{k} >= filled' for k in grid.SIDES)}, false) as flat from gn, ends)",
    "level as (select *, case when flat then filled end as level from flat)",
    near("ln", "level", "level"),
]


@query(_sql(CELLS, ENDS, HOLES, *_FLATS, select=f"select r, c, flat, coalesce(not flat and greatest({', '.join(f'level_{k}' for k in grid.SIDES)}) = filled, false) as sill from ln"))
def flats_sills(spark, d):
    return hydrology.flats_and_sills(hydrology.fill_depressions(holes(spark, d))).select("r", "c", "flat", "sill")


_D8 = [
    "kn as (select r, c, z, c::bigint * m + r + 1 as idx, {'z': coalesce(z, '-inf'::double), 'i': -(c::bigint * m + r + 1)} as k from holes, ends)",
    near("kk", "kn", "k"),
    "kd as (select *, least(k, k_n, k_s, k_w, k_e) as kc, least(k, k_nw, k_ne, k_sw, k_se) as kg from kk)",
    """kr as (select *, case when kc.i = k.i then '-inf'::double when isinf(kc.z) then null else (z - kc.z) / 10.0 end as g1,
      case when kg.i = k.i then '-inf'::double when isinf(kg.z) then null else (z - kg.z) / (10.0 * sqrt(2.0)) end as g2 from kd)""",
    "kt as (select *, case when coalesce(g1 <= g2, false) and kg < kc then kg else kc end as t from kr)",
    "flow as materialized (select r, c, idx, case when z is not null and not isinf(t.z) and t.i <> k.i then -t.i end as recv from kt)",
]


@query(with_sql(CELLS, ENDS, HOLES, *_D8, select="select r, c, idx, recv from flow"))
def d8_receiver(spark, d):
    """Receivers on unfilled terrain, which has no flats here; ``flow_carved`` goes through them."""
    return hydrology.flow_direction(holes(spark, d), preprocess="none").select("r", "c", "idx", "recv")


@query(_sql(CELLS, ENDS, HOLES, *_D8, "way as (select recv as cell from flow where recv is not null union all select f.recv from way join flow f on f.idx = way.cell where f.recv is not null)", "acc as (select cell as idx, count(*) as n from way group by cell)", select="select r, c, coalesce(n, 0) + 1.0::double as acc from flow left join acc using (idx)"))
def flow_accumulation(spark, d):
    return hydrology.flow_accumulation(hydrology.flow_direction(holes(spark, d), preprocess="none")).select("r", "c", "acc")


_SILLS = [
    *_FLATS,
    f"sf as (select r, c, filled, flat, coalesce(not flat and greatest({', '.join(f'level_{k}' for k in grid.SIDES)}) = filled, false) as sill from ln)",
    "sv as materialized (select sf.*, h.z, case when sill then filled end as sl, sf.c::bigint * m + sf.r + 1 as idx from sf join holes h on h.r = sf.r and h.c = sf.c, ends)",
    near("sn", "sv", "sl"),
    f"pre as materialized (select r, c, idx, z, filled, flat, sill, flat and ({' or '.join(f'coalesce(sl_{k} = filled, false)' for k in grid.SIDES)}) as presill from sn)",
]
_CARVED = [
    *_SILLS, *components_sql("fc", "sv", mask="flat"),
    "deep as (select root, max(filled - z) as most from fc group by root)",
    "cost as materialized (select p.r, p.c, p.idx, p.presill, pow(most - (p.filled - p.z), 2.0) + 0.1 as cost from pre p join fc on fc.idx = p.idx join deep using (root))",
    f"ge as materialized (select a.idx as a, b.idx as b, (case when dr <> 0 and dc <> 0 then sqrt(2.0) else 1.0 end) * 0.5 * (a.cost + b.cost) as w from cost a cross join (values {_MOVES}) o(dr, dc) join cost b on b.r = a.r + dr and b.c = a.c + dc)",
    """gd(idx, h) using key (idx) as (select idx, case when presill then 0.0::double else 'inf'::double end as h from cost
      union select e.b, min(l.h + e.w) from gd l join ge e on e.a = l.idx join recurring.gd o on o.idx = e.b where l.h + e.w < o.h group by e.b)""",
]
_ROUTED = [
    *_CARVED,
    "kn as (select p.r, p.c, p.idx, filled as z, {'z': coalesce(filled, '-inf'::double), 'a': coalesce(gd.h + 1, '-inf'::double), 'i': -p.idx} as k from pre p left join gd on gd.idx = p.idx)",
    *_D8[1:],
]


@query(_sql(CELLS, ENDS, HOLES, *_SILLS, select="select r, c, presill from pre"))
def presill_cells(spark, d):
    return hydrology.presills(cut(hydrology.flats_and_sills(hydrology.fill_depressions(holes(spark, d))))).select("r", "c", "presill")


@query(_sql(CELLS, ENDS, HOLES, *_CARVED, select="select p.r, p.c, p.flat, round(case when cost.idx is null then p.filled - p.z else cost.cost end, 6) as cost, round(gd.h + 1, 6) as aux from pre p left join cost on cost.idx = p.idx left join gd on gd.idx = p.idx"))
def flat_cost_distance(spark, d):
    """Cost of cells in flats, and the cheapest way to them from a presill."""
    g = cut(hydrology.presills(cut(hydrology.flats_and_sills(hydrology.fill_depressions(holes(spark, d))))))
    got = hydrology.flat_distance(cut(hydrology.carve_cost(g)))
    return got.select("r", "c", "flat", F.round(F.when(F.col("z").isNotNull(), F.col("cost")), 6).alias("cost"), F.round("aux", 6).alias("aux"))


@query(_sql(CELLS, ENDS, HOLES, *_FILL, "has_fill as (select r, c, z, filled, filled is not null as has from filled)", *components_sql("comp", "has_fill", mask="has", same="filled"), near("g", "has_fill", "filled"),
    f"low as (select distinct root from comp join (select r, c from g where least({', '.join(f'filled_{k}' for k in grid.SIDES)}) < filled) using (r, c))",
    "rim as (select distinct root from comp, ends where r = 0 or c = 0 or r = mr or c = mc)",
    select="select r, c, coalesce(root not in (select root from low) and root not in (select root from rim), false) as closed from has_fill left join (select r, c, root from comp) using (r, c)"))
def closed_minima(spark, d):
    return hydrology.closed_minima(cut(hydrology.fill_depressions(holes(spark, d)))).select("r", "c", "closed")


@query(_sql(CELLS, ENDS, HOLES, *_ROUTED, "way as (select recv as cell from flow where recv is not null union all select f.recv from way join flow f on f.idx = way.cell where f.recv is not null)", "acc as (select cell as idx, count(*) as n from way group by cell)", select="select r, c, recv, coalesce(n, 0) + 1.0::double as acc from flow left join acc using (idx)"))
def flow_carved(spark, d):
    """Receivers and accumulation after carving through flats."""
    return hydrology.flow_accumulation(hydrology.flow_direction(holes(spark, d))).select("r", "c", "recv", "acc")


def _renamed(ctes: list[str], suffix: str) -> list[str]:
    """CTEs under other names, so that they can stand twice in one query."""
    names = sorted({re.match(r"\s*(\w+)", x)[1] for x in ctes}, key=len, reverse=True)
    return [re.sub(rf"\b({'|'.join(names)})\b", rf"\1{suffix}", x) for x in ctes]


def _above(suffix: str, z: str, least: int) -> list[str]:
    """CTEs mask<suffix>: accumulation above ``least`` on the padded grid with heights ``z``, diagonal steps filled."""
    source = f"holes as (select r, c, v, {z} as z from padded)"
    way = "way as (select recv as cell from flow where recv is not null union all select f.recv from way join flow f on f.idx = way.cell where f.recv is not null)"
    many = f"many as (select r, c, coalesce(n, 0) + 1 > {least} as mask from flow left join (select cell as idx, count(*) as n from way group by cell) using (idx))"
    return _renamed([source, *_ROUTED, way, many, *passes_sql("line", "many", [("diag", 1)])], suffix)


_THINNED = [("skel", 40), ("bridge", 1), ("diag", 1)]


@query(_sql(CELLS, ENDS, PADDED, *_above("_v", "z", 100), *_above("_r", "(select max(z) + min(z) from padded) - z", 5),
    "both_lines as (select r, c, line_r.mask as ridge, line_v.mask as valley, line_r.mask or line_v.mask as mask from line_r join line_v using (r, c))", *passes_sql("thin", "both_lines", _THINNED),
    select="select r, c, ridge, valley, thin.mask as nogrow from both_lines join thin using (r, c)"))
def ridge_valley_mask(spark, d):
    return hydrology.ridges_and_valleys(grid.pad(cells(spark, d)))


@query(with_sql(CELLS, ENDS, UNITS, near("g", "units", "a", sides={"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1)}),
    "edge as (select r, c, z is not null and a > 0 and (" + " or ".join(f"coalesce(a_{k} <> a, false)" for k in "nswe") + ") as mask from g)", *passes_sql("thin", "edge", _THINNED),
    select="select r, c, mask as nogrow from thin"))
def nogrow_from_units(spark, d):
    return hydrology.nogrow_from_units(units(spark, d).withColumnRenamed("a", "unit"))


_LINES = "lines as (select r, c, z, z is not null and r % 10 = 0 and v < 0.15 as ridge, c % 13 = 5 as valley, z is not null as valid from holes)"
_OPEN = "open as (select *, valid and not (ridge or valley) as mask from lines)"


@query(_sql(CELLS, ENDS, HOLES, _LINES, _OPEN, *components_sql("comp", "open", diagonal=False),
    "kept as (select root, min({'r': r, 'c': c}) as first from comp group by root having count(*) >= 4)",
    "named as (select root, row_number() over (order by first) as unit from kept)",
    "grown as (select l.r, l.c, coalesce(unit, 0) as unit, valid and not valley and coalesce(unit, 0) = 0 as room from lines l left join (select r, c, root from comp) using (r, c) left join named using (root))",
    f"o as (select * from (values {_OFFSETS}) o(a, b))",
    "best as (select r, c, min({'d': d, 'l': unit}) as x from (select s.r + a as r, s.c + b as c, a * a + b * b as d, unit from grown s cross join o where unit > 0) group by r, c)",
    select="select r, c, case when unit > 0 then unit when room then coalesce(x.l, 0) else 0 end as unit from grown left join best using (r, c)"))
def reconstruct_units(spark, d):
    has = F.col("z").isNotNull()
    g = holes(spark, d).select("r", "c", (has & (F.col("r") % 10 == 0) & (F.col("v") < 0.15)).alias("ridge"), (F.col("c") % 13 == 5).alias("valley"), has.alias("valid"))
    return hydrology.reconstruct_units(g).select("r", "c", "unit")


def _hill_step(k: int) -> list[str]:
    wide = {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1), "n2": (-2, 0), "s2": (2, 0), "w2": (0, -2), "e2": (0, 2), "nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)}
    return [
        near(f"hn{k}", f"h{k}", "z", sides=wide),
        f"hg{k} as (select *, rock - 0.0003 * exp(-3.0 * (z - rock)) as nrock, (z_e - z_w) / 20.0 as gx, (z_s - z_n) / 20.0 as gy from hn{k}, ends)",
        f"""hd{k} as (select *, sqrt(gx * gx + gy * gy) as slope, 1 - (sqrt(gx * gx + gy * gy) / 1.25) ** 2 as den, (z_w + z_e + z_n + z_s - 4 * z) / 100.0 as lap,
          2 * (gx * gx * ((z_e2 - 2 * z + z_w2) / 400.0) + gy * gy * ((z_s2 - 2 * z + z_n2) / 400.0) + 2 * gx * gy * ((z_se - z_sw - z_ne + z_nw) / 400.0)) as curve from hg{k})""",
        f"""h{k + 1} as (select r, c, case when r = 0 or c = 0 or r = mr or c = mc or z is null then z when slope is null or slope >= 1.25 * (1 - 0.025) then nrock
          when curve is null or den <= 0 then greatest(z, nrock) else greatest(z + 0.005 / 2.0 * (lap / den + curve / (1.5625 * den * den)), nrock) end as z, case when z is null then rock else nrock end as rock from hd{k})""",
    ]


@query(with_sql(CELLS, ENDS, HOLES, "h0 as (select r, c, z, z - 1 as rock from holes)", *(x for k in range(4) for x in _hill_step(k)), select="select r, c, round(z - rock, 6) as depth from h4"))
def soil_depth_4steps(spark, d):
    """An end time of -497 years leaves four steps."""
    return hillslope.soil_depth(holes(spark, d).select("r", "c", "z"), -497.0).select("r", "c", F.round("depth", 6).alias("depth"))


@query()
def soil_depth(spark, d):
    """The model's default end time: 5,501 steps."""
    return hillslope.soil_depth(holes(spark, d).select("r", "c", "z")).select("r", "c", "depth")


#: Unstable cells of all runs at once: runs lie apart in key and grid.
_SLIDES = [*STATE, runs_sql(), LIVE, BY_RUN, *forces_sql("f", "sr"), "bad as (select *, z is not null and q > 0 as mask from f)", *components_sql("comp", "bad", by="run"),
           "big as (select run, root, count(*) as cells from comp group by run, root having count(*) >= 7)", "slides as (select run, r, c, root from comp join big using (run, root))"]


def slides(spark, d, rows=RUNS):
    """(run, r, c, root) of unstable components of 7 cells or more, before any clean-up; and the forces."""
    forces = cut(regional.forces_by_run(state(spark, d), runs(spark, rows)))
    m, _ = grid.extent(forces)
    # one grid of all runs, with an empty row between them
    stack = forces.select((F.col("r") + F.col("run") * (m + 1)).alias("r"), "c", (F.col("z").isNotNull() & (F.col("q") > 0)).alias("mask"))
    found = cut(labels.components(stack))
    big = found.join(labels.sizes(found).where("cells >= 7").select("root"), "root", "left_semi")
    run = F.floor(F.col("r") / (m + 1)).cast("int")
    own = big.select(run.alias("run"), (F.col("r") % (m + 1)).cast("int").alias("r"), "c", "root").withColumn("idx", grid.idx(m))
    first = own.groupBy("run", "root").agg(F.min("idx").alias("first"))  # clusters are known by their first cell
    return own.join(first, ["run", "root"]).select("run", "r", "c", F.col("first").alias("root")), forces


def _summary(spark, found, rows=RUNS):
    return scenarios.run_summary(found.withColumnRenamed("root", "cluster"), runs(spark, rows))


_SUS = "select r, c, case when z is not null then round(100 * coalesce(p, 0), 6) end as sus from padded left join (select r, c, sum(prob) as p from slides join runs using (run) group by r, c) using (r, c)"


@query(_sql(*_SLIDES, select=_SUS))
def susceptibility_before_growth(spark, d):
    found, _ = slides(spark, d)
    return scenarios.susceptibility(found.select("run", "r", "c"), _summary(spark, found), grid.pad(cells(spark, d)).select("r", "c", "z")).select("r", "c", F.round("sus", 6).alias("sus"))


_BREAK = [x.replace(runs_sql(), runs_sql(BROKEN)) for x in _SLIDES] + [
    "n as (select run, prob, (select count(distinct root) from slides s where s.run = live.run) as n_clusters from live)",
    "active as (select * from n where run < coalesce((select min(run) from n where n_clusters = 0), 999))",
]


@query(_sql(*_BREAK, select=_SUS.replace("join runs using", "join active using")))
def susceptibility_early_break(spark, d):
    found, _ = slides(spark, d, BROKEN)
    return scenarios.susceptibility(found.select("run", "r", "c"), _summary(spark, found, BROKEN), grid.pad(cells(spark, d)).select("r", "c", "z")).select("r", "c", F.round("sus", 6).alias("sus"))


@query(_sql(*_SLIDES, select="select run, phi, coh, prob, (select count(distinct root) from slides s where s.run = runs.run) as n_clusters from runs"))
def cluster_counts_before_growth(spark, d):
    found, _ = slides(spark, d)
    return _summary(spark, found)


@query(_sql(*_SLIDES, select="select r, c, case when z is not null then round(coalesce(x, 0), 4) end as force from padded left join (select r, c, sum(prob * -coalesce(q, 0)) as x from slides join f using (run, r, c) group by r, c) using (r, c)"))
def net_force_before_growth(spark, d):
    found, forces = slides(spark, d)
    out = scenarios.net_force(forces.select("run", "r", "c", "q"), found.select("run", "r", "c"), _summary(spark, found), grid.pad(cells(spark, d)).select("r", "c", "z"))
    return out.select("r", "c", F.round("force", 4).alias("force"))


def _banked(spark, d):
    c = cells(spark, d)
    run = F.explode(F.array(*(F.struct(F.lit(k).alias("run"), F.lit(p).alias("prob")) for k, p in ((1, 0.5), (2, 0.3), (4, 0.2))))).alias("x")
    return c.select("r", "c", "v", run).where(F.col("v") > F.col("x.run") * 0.04).select("x.run", "r", "c", "x.prob", F.when(F.col("x.run") == 4, 5).otherwise(4).alias("n_runs"), F.lit(False).alias("no_slides"))


_BANK = "bank as (select run, r, c, prob, case when run = 4 then 5 else 4 end as n_runs from cells, (values (1, 0.5::double), (2, 0.3::double), (4, 0.2::double)) x(run, prob) where v > run * 0.04)"


@query(with_sql(CELLS, _BANK, select="select r, c, round(100 * coalesce(p, 0), 6) as sus from cells left join (select r, c, sum(prob) as p from bank group by r, c) using (r, c)"))
def aggregate_contributions(spark, d):
    """Contributions as banked (in a folder by run) and read again."""
    path = f"{scenarios_dir(spark)}/bank"
    scenarios.bank(_banked(spark, d), path)
    return scenarios.aggregate_contributions(spark.read.parquet(path), cells(spark, d).select("r", "c", "z")).select("r", "c", F.round("sus", 6).alias("sus"))


def scenarios_dir(spark) -> str:
    import uuid

    from talus.plans.checkpoints import shared_dir

    return f"{shared_dir(spark)}/contributions-{uuid.uuid4().hex}"


@query(with_sql(CELLS, _BANK, "have as (select run, min(n_runs) as lo, max(n_runs) as hi from bank group by run)",
    select="select i::int as run, 'missing' as problem from range(1, 4 + 1) t(i) where i not in (select run from have) union all select run, 'extra' from have where run > 4 union all select run, 'other n_runs' from have where lo <> 4 or hi <> 4"))
def contribution_gaps(spark, d):
    return scenarios.contribution_gaps(_banked(spark, d), 4)


@query(_sql(*_SLIDES, select="select run, root % 100000000 as cluster, round(sum(w) / (sum(depth) * 100.0), 6) as gamma from slides join f using (run, r, c) group by run, root"))
def cluster_weight(spark, d):
    found, forces = slides(spark, d)
    rows = found.join(forces.select("run", "r", "c", "w", "depth"), ["run", "r", "c"]).withColumn("cluster", F.struct("run", "root"))
    return zonal.unit_weight(rows).select("cluster.run", F.col("cluster.root").alias("cluster"), F.round("gamma", 6).alias("gamma"))


@query(_sql(*_SLIDES, "box as (select run, root, min(r) as a, max(r) as b, min(c) as k, max(c) as l from slides group by run, root)",
    select="select run, root % 100000000 as cluster, count(*) as cells, round(sum(z), 3) as sum_z from box join cells on r between a - 20 and b + 20 and c between k - 20 and l + 20 group by run, root"))
def cluster_window_rangejoin(spark, d):
    """Cells of each cluster's box and 20 around it, by an equi-join on the tiles it covers."""
    found, _ = slides(spark, d)
    inside = growth.windows(growth.bounds(found.withColumnRenamed("root", "cluster")), regional.by_run(cells(spark, d).select("r", "c", "z"), runs(spark)), 20, 32)
    return inside.groupBy("run", "cluster").agg(F.count("*").alias("cells"), F.round(F.sum("z"), 3).alias("sum_z"))


_ROTS = """rot as (select f.run, root, rot_id, f.r, f.c, f.z, f.w, f.sigma_s, f.pga, phi, coh, sqrt(subdx * subdx + subdy * subdy) * cos(radians(-20.0 + 40.0 * rot_id / 7)) as len, degrees(atan2(subdy, subdx)) - 20.0 + 40.0 * rot_id / 7 as turn
  from slides join f using (run, r, c) cross join range(8) t(rot_id))"""


@query(_sql(*_SLIDES, _ROTS, "rr as (select * exclude (len, turn), len * cos(radians(turn)) as subdx, len * sin(radians(turn)) as subdy from rot)", *forces_sql("g", "rr"),
    "s as (select run, root, rot_id, coalesce(sum(qx), 0) as x, coalesce(sum(qy), 0) as y, sum(w) as w from g group by run, root, rot_id)",
    select="select run, root % 100000000 as cluster, round(min(sqrt(x * x + y * y)), 4) as err, round(max(w), 4) as weight, min(sqrt(x * x + y * y)) <= max(w) / 100 as closed from s group by run, root"))
def rotation_closure(spark, d):
    """Least force sum of each cluster over the rotations, against 1 % of its weight."""
    found, forces = slides(spark, d)
    rows = found.join(forces, ["run", "r", "c"])
    turned = physics.project_slope(physics.with_rotations(rows)).drop("subdx", "subdy", "q", "qx", "qy").withColumnsRenamed({"dx1": "subdx", "dy1": "subdy"})
    q = physics.column_forces(turned, F.col("phi"), F.col("coh"))
    s = q.groupBy("run", "root", "rot_id").agg(F.coalesce(F.sum("qx"), F.lit(0.0)).alias("x"), F.coalesce(F.sum("qy"), F.lit(0.0)).alias("y"), F.sum("w").alias("w"))
    err = F.min(F.hypot("x", "y"))
    return s.groupBy("run", F.col("root").alias("cluster")).agg(F.round(err, 4).alias("err"), F.round(F.max("w"), 4).alias("weight"), (err <= F.max("w") / 100).alias("closed"))


@query(_sql(CELLS, ENDS, UNITS, "on_a as (select *, a > 0 and (r + c) % 17 <> 0 as mask from units)", *components_sql("comp", "on_a", diagonal=False, same="a"),
    "p as (select a as unit, root, count(*) as n_cells, min({'r': r, 'c': c}) as first from comp group by a, root)",
    select="select unit, row_number() over (partition by unit order by first) as part, n_cells, n_cells * 100.0::double as area_m2 from p where n_cells >= 2"))
def unit_parts(spark, d):
    u = units(spark, d).withColumn("unit", F.when((F.col("r") + F.col("c")) % 17 != 0, F.col("a")).otherwise(0))
    return vector.polygonize(u, least=2).select("unit", F.col("part").cast("long").alias("part"), "n_cells", "area_m2")


@query(with_sql(CELLS, UNITS, select="select r, c, case when r % 9 < 7 and c > 3 then a else 0 end as unit from units"))
def clip_by_mask(spark, d):
    u = units(spark, d).withColumnRenamed("a", "unit")
    return vector.clip_by_mask(u, u.where("r % 9 < 7 and c > 3")).select("r", "c", "unit")


@query()
def unit_outlines(spark, d):
    return vector.union_by_unit(vector.outlines(units(spark, d).withColumnRenamed("a", "unit")))


_CLEANED = passes_sql("chained", "mask", [(op, 5) for op in ("spur", "bridge", "fill", "majority", "spur", "clean", "spur")])


@query(_sql(CELLS, ENDS, MASK, *_CLEANED, *components_sql("comp", "chained"), "big as (select root from comp group by root having count(*) >= 7)",
    select="select r, c, coalesce(root in (select root from big), false) as mask from chained left join (select r, c, root from comp) using (r, c)"))
def initial_cleanup(spark, d):
    """The clean-up of unstable cells, in one exchange."""
    return morphology.cleanup(masked(spark, d), 5, 7).select("r", "c", "mask")


@query()
def cluster_growth(spark, d):
    """The whole regional run on all strengths: cells painted per run and cluster."""
    got = regional.regional(cells(spark, d), runs(spark))
    return got["clusters"].groupBy("run", "cluster", "kind", "code").agg(F.count("r").alias("cells"), F.max("cycles").alias("cycles"))


@query()
def susceptibility(spark, d):
    """The map that the whole regional run is for: clean-up, growth and all strengths, with default settings."""
    return regional.regional(cells(spark, d), runs(spark))["sus"].select("r", "c", F.round("sus", 6).alias("sus"))


_CHAIN = [(op, 5) for op in ("spur", "bridge", "fill", "majority", "spur", "clean", "spur")]
_CANDIDATES = [*STATE, runs_sql(), LIVE, BY_RUN, *forces_sql("f", "sr"), "bad as (select run, r, c, z is not null and q > 0 as mask from f)", *passes_sql("chained", "bad", _CHAIN, "run"),
               *components_sql("comp", "chained", by="run"), "big as (select run, root from comp group by run, root having count(*) >= 7)",
               "counted as (select run, phi, coh, prob, (select count(*) from big where big.run = live.run) as n from live)"]


@query(_sql(*_CANDIDATES, select="select run, phi, coh, prob, case when run < coalesce((select min(run) from counted where n = 0), 999) then n else 0 end as n_clusters from counted"))
def run_cluster_counts(spark, d):
    """Candidate clusters of each strength after the clean-up, as the whole regional run reports them."""
    return regional.begun(cells(spark, d), runs(spark))["summary"]


@query(_sql(*_CANDIDATES, "cut as (select coalesce(min(run), 999) as stop from counted where n = 0)",
    "ranked as (select run, root, dense_rank() over (partition by run order by root) as cluster from big)",
    select="select run, cluster, r, c from comp join ranked using (run, root), cut where run < stop"))
def candidate_clusters(spark, d):
    """Cells of the candidate clusters of all strengths, numbered in each."""
    return regional.begun(cells(spark, d), runs(spark))["clusters"].select("run", "cluster", "r", "c")


@query()
def termination_histogram(spark, d):
    got = regional.regional(cells(spark, d), runs(spark))
    return zonal.termination_histogram(got["clusters"].select("run", "cluster", "code").distinct())


@query(_sql(CELLS, ENDS, PADDED, *_L8[2:], select="select root, round(avg(z), 6) as mean, round(max(z), 6) as top from comp group by root"))
def label_maximum(spark, d):
    """Largest and mean value per component."""
    found = labels.components(masked(spark, d)).join(cells(spark, d).select("r", "c", "z"), ["r", "c"])
    return rounded(zonal.by_label(found, "z"), "root")

