"""Grids derived from the given tables by one formula, for the engine and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import grid, scenarios
from talus.operators.grid import SIDES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RUNS = [(1, 36.0, 4.0, 0.4), (2, 34.0, 4.0, 0.3), (3, 30.0, 2.0, 0.0), (4, 38.0, 3.0, 0.2), (5, 33.0, 3.0, 0.1)]
#: A run of positive probability that is too strong to slide: those after it do not count.
BROKEN = [(1, 36.0, 4.0, 0.4), (2, 45.0, 900.0, 0.3), (3, 34.0, 4.0, 0.3)]


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def with_sql(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join(ctes)} {select}"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """r = vec_id, c = place in the vector, z = trend and noise."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("c", "v"))
    v = F.col("v").cast("double")
    z = 300.0 + 5 * F.abs(F.col("vec_id") % 40 - 20) + 3 * F.abs(F.col("c") % 32 - 16) + 12 * v
    return e.select(F.col("vec_id").cast("int").alias("r"), "c", z.alias("z"), v.alias("v"))


CELLS = """cells as (select vec_id::int as r, (i - 1)::int as c,
  300.0::double + 5 * abs(vec_id % 40 - 20) + 3 * abs((i - 1) % 32 - 16) + 12 * embedding[i]::double as z, embedding[i]::double as v
  from (select vec_id, embedding, unnest(range(1, len(embedding) + 1))::int as i from embeddings))"""
ENDS = "ends as (select max(r) as mr, max(c) as mc, max(r) + 1 as m from cells)"
PADDED = "padded as (select r, c, v, case when r > 0 and c > 0 and r < mr and c < mc then z end as z from cells, ends)"
HOLES = "holes as (select r, c, v, case when (r * 7 + c * 13) % 97 <> 0 then z end as z from cells)"
MASK = "mask as (select r, c, v, z, v > 0.08 as mask from cells)"


def padded(spark: SparkSession, d: str) -> DataFrame:
    return grid.pad(cells(spark, d))


def holes(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).withColumn("z", F.when((F.col("r") * 7 + F.col("c") * 13) % 97 != 0, F.col("z")))


def masked(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).withColumn("mask", F.col("v") > 0.08)


def units(spark: SparkSession, d: str) -> DataFrame:
    """Two partitions in blocks: a of 25 x 16 cells, b of 20 x 8; a has a strip without unit."""
    x = cells(spark, d)
    a = F.floor(F.col("r") / 25) * 100 + F.floor(F.col("c") / 16) + 1
    b = F.floor(F.col("r") / 20) * 100 + F.floor(F.col("c") / 8) + 1
    return x.select("r", "c", "z", F.when(F.col("r") % 50 != 3, a).otherwise(0).cast("int").alias("a"), b.cast("int").alias("b"))


UNITS = "units as (select r, c, z, (case when r % 50 <> 3 then (r // 25) * 100 + c // 16 + 1 else 0 end)::int as a, ((r // 20) * 100 + c // 8 + 1)::int as b from cells)"


def runs(spark: SparkSession, rows: list = RUNS) -> DataFrame:
    return scenarios.strength(spark, rows)


def runs_sql(rows: list = RUNS) -> str:
    return f"runs(run, phi, coh, prob) as (values {', '.join(f'({a}, {b}::double, {c}::double, {p}::double)' for a, b, c, p in rows)})"


def near(out: str, src: str, *columns: str, on: tuple[str, ...] = (), sides: dict = SIDES) -> str:
    """A CTE with neighbours ``<column>_<side>`` by joins of the table with itself."""
    extra = "".join(f" and {{k}}.{x} = a.{x}" for x in on)
    pick = ", ".join(f"x_{k}.{c} as {c}_{k}" for c in columns for k in sides)
    joins = " ".join(f"left join {src} x_{k} on x_{k}.r = a.r + ({dr}) and x_{k}.c = a.c + ({dc})" + extra.format(k=f"x_{k}") for k, (dr, dc) in sides.items())
    return f"{out} as (select a.*, {pick} from {src} a {joins})"


def horn_sql(out: str, src: str, z: str = "z") -> list[str]:
    """CTEs out with dzdx, dzdy, slope, aspect."""
    edge = "(r = 0 or c = 0 or r = mr or c = mc)"
    return [
        near(f"{out}_n", src, z),
        f"""{out}_g as (select *, (({z}_ne + 2 * {z}_e + {z}_se) - ({z}_nw + 2 * {z}_w + {z}_sw)) / 80.0 as gx,
          (({z}_sw + 2 * {z}_s + {z}_se) - ({z}_nw + 2 * {z}_n + {z}_ne)) / 80.0 as gy from {out}_n, ends)""",
        f"""{out} as (select * exclude (gx, gy), case when {edge} then 0.0 else gx end as dzdx, case when {edge} then 0.0 else gy end as dzdy,
          case when {edge} then 0.0 else atan(sqrt(gx * gx + gy * gy)) * 57.29578 end as slope,
          case when {edge} then 0.0 else floor(case when 57.29578 * atan2(gy, -gx) > 90 then 450.0 - 57.29578 * atan2(gy, -gx) else 90.0 - 57.29578 * atan2(gy, -gx) end + 0.5) end as aspect from {out}_g)""",
    ]


#: Hydrostatic state on the padded grid with a depth of 2 m, half saturated, and the substrate's gradient.
STATE = [CELLS, ENDS, PADDED, "sub as (select *, z - 2.0 as z_sub from padded)", *horn_sql("hs", "sub", "z_sub"), "state as (select r, c, z, 2.0::double as depth, 1.0::double as hw, 9.8::double as sigma_s, 9.8::double as sigma_w, (1.0 * 20 + 1.0 * 16) * 100.0::double as w, 0.0::double as pga, dzdx as subdx, dzdy as subdy from hs)"]


def forces_sql(out: str, src: str) -> list[str]:
    """CTEs out with column forces; src has phi and coh."""
    return [
        f"""{out}_a as (select *, sqrt(subdx * subdx + subdy * subdy) as fm, atan(sqrt(subdx * subdx + subdy * subdy)) as fa, atan(subdx) as fx, atan(subdy) as fy from {src})""",
        f"""{out}_b as (select *, 100.0 * sqrt(1 - sin(fx) * sin(fx) * sin(fy) * sin(fy)) / (cos(fx) * cos(fy)) as fr from {out}_a)""",
        f"""{out}_c as (select *, (w + sigma_s * fr * sin(fa) * tan(radians(phi)) - coh * fr * sin(fa)) / (cos(fa) + sin(fa) * tan(radians(phi))) as fn from {out}_b)""",
        f"""{out}_d as (select *, fn * sin(fa) - (coh * fr + (fn - sigma_s * fr) * tan(radians(phi))) * cos(fa) + pga * w as fq from {out}_c)""",
        f"""{out} as materialized (select * exclude (fm, fa, fx, fy, fr, fn, fq), case when z is null then 0 else fq end as q, case when z is null then 0 else -subdx / nullif(fm, 0) * fq end as qx,
          case when z is null then 0 else -subdy / nullif(fm, 0) * fq end as qy, case when z is null then 0 else fr end as area, case when z is null then 0 else fn end as normal,
          case when z is null then 0 else sigma_s * fr end as uplift, case when z is null then 0 else degrees(fa) end as alpha,
          case when z is null then 0 else degrees(atan2(-subdy / nullif(fm, 0) * fq, -subdx / nullif(fm, 0) * fq)) end as theta from {out}_d)""",
    ]


def components_sql(out: str, src: str, mask: str = "mask", diagonal: bool = True, same: str | None = None, by: str | None = None) -> list[str]:
    """CTEs (for a recursive WITH) out with idx and root of set cells, by smallest labels spread along links."""
    key = "c::bigint * m + r + 1" + (f" + {by} * 100000000::bigint" if by else "")
    offsets = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and (diagonal or not (dr and dc))]
    moves = ", ".join(f"({dr}, {dc})" for dr, dc in offsets)
    return [
        f"{out}_on as materialized (select *, {key} as idx from {src}, (select m from ends) where {mask})",
        f"{out}_m as materialized (select a.idx as a, a.idx + dr + dc * m as b{f', a.{same} as s' if same else ''} from {out}_on a cross join (values {moves}) o(dr, dc) where a.r + dr between 0 and m - 1)",
        f"{out}_e as materialized (select a.a, a.b from {out}_m a join {out}_on b on b.idx = a.b{f' where a.s = b.{same}' if same else ''})",
        f"""{out}_l(idx, root) using key (idx) as (select idx, idx as root from {out}_on
          union select e.b, min(l.root) from {out}_l l join {out}_e e on e.a = l.idx join recurring.{out}_l o on o.idx = e.b where l.root < o.root group by e.b)""",
        f"{out} as materialized (select t.*, root from {out}_on t join {out}_l using (idx))",
    ]


_CLOCK = ("n", "ne", "e", "se", "s", "sw", "w", "nw")
_SET = "(" + " + ".join(f"{k}::int" for k in _CLOCK) + ")"
_TURNS = "(" + " + ".join(f"(not {a} and {b})::int" for a, b in zip(_CLOCK, (*_CLOCK[1:], "n"), strict=True)) + ")"
_THIN = f"mask and not ({_SET} between 2 and 6 and {_TURNS} = 1 and not ({{}}) and not ({{}}))"
#: One pass of each operation over a cell (mask) and its neighbours (n, ne ...).
PASSES = {
    "clean": [f"mask and {_SET} > 0"],
    "fill": [f"mask or {_SET} = 8"],
    "majority": [f"mask::int + {_SET} >= 5"],
    "spur": [f"mask and {_SET} > 1"],
    "diag": ["mask or " + " or ".join(f"({a} and {b} and not {a}{b})" for a in "ns" for b in "we")],
    # stretches of the ring, a corner between two set sides counting as set: their first cells are counted
    "bridge": ["mask or " + " + ".join(f"({k} and not ({p} or {q}))::int" for k, p, q in (("n", "nw", "w"), ("e", "ne", "n"), ("s", "se", "e"), ("w", "sw", "s")))
               + " + " + " + ".join(f"({k} and not {p})::int" for k, p in (("ne", "n"), ("se", "e"), ("sw", "s"), ("nw", "w"))) + " >= 2"],
    "skel": [_THIN.format("n and e and s", "e and s and w"), _THIN.format("n and e and w", "n and s and w")],
}


def passes_sql(out: str, src: str, steps: list[tuple[str, int]], by: str | None = None) -> list[str]:
    """CTEs out (r, c, mask): the passes of ``steps`` in turn over a dense src (r, c, mask), apart by the column ``by``."""
    rules, ctes, own = [x for op, k in steps for _ in range(k) for x in PASSES[op]], [], f"{by}, " if by else ""
    for i, rule in enumerate(rules):
        last, name = i == len(rules) - 1, f"{out}_{i}"
        ctes += [
            f"{name}a as (select {own}r, c, mask, coalesce(lag(mask) over x, false) as w, coalesce(lead(mask) over x, false) as e from {src} window x as (partition by {own}r order by c))",
            f"""{name}b as (select {own}r, c, mask, w, e, coalesce(lag(mask) over y, false) as n, coalesce(lag(w) over y, false) as nw, coalesce(lag(e) over y, false) as ne,
              coalesce(lead(mask) over y, false) as s, coalesce(lead(w) over y, false) as sw, coalesce(lead(e) over y, false) as se from {name}a window y as (partition by {own}c order by r))""",
            f"{out if last else name} as materialized (select {own}r, c, {rule} as mask from {name}b)",
        ]
        src = name
    return ctes
