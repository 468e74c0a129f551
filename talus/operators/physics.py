"""Per-cell hydrology, seismic load and the equilibrium of soil columns. Angles in degrees, weights in kN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.degrees import atan2d, atand, cosd, sind, tand

GAMMA_WATER, GAMMA_DRY, GAMMA_SAT = 9.8, 16.0, 20.0


def uniform_depth(df: DataFrame, depth: float = 2.0) -> DataFrame:
    return df.withColumn("depth", F.lit(float(depth)))


def dry(df: DataFrame, dx: float = 10.0, dy: float = 10.0, gamma_dry: float = GAMMA_DRY) -> DataFrame:
    """df (with depth) with hw, sigma_s, sigma_w and w without water."""
    zero = F.col("depth") * 0.0
    return df.withColumns({"hw": zero, "sigma_s": zero, "sigma_w": zero, "w": gamma_dry * F.col("depth") * (dx * dy)})


def hydrostatic(df: DataFrame, mw: float = 0.5, dx: float = 10.0, dy: float = 10.0, gamma_w: float = GAMMA_WATER, gamma_dry: float = GAMMA_DRY, gamma_sat: float = GAMMA_SAT, wedge: str = "matlab_local") -> DataFrame:
    """df (with depth) with water height, pore pressure below the column and beside it, and weight."""
    if wedge not in ("matlab_local", "physical"):
        raise ValueError(f"unknown wedge mode: {wedge!r}")
    out = df.withColumn("hw", mw * F.col("depth"))
    out = out.withColumn("sigma_s", gamma_w * F.col("hw"))
    weight = (F.col("hw") * gamma_sat + (F.col("depth") - F.col("hw")) * gamma_dry) * (dx * dy)
    return out.withColumns({"sigma_w": F.col("sigma_s") * (1.0 if wedge == "matlab_local" else 0.5), "w": weight})


def hydrology(df: DataFrame, mode: int, **options) -> DataFrame:
    if mode == 0:
        return dry(df, **options)
    if mode == 1:
        return hydrostatic(df, **options)
    if mode == 2:
        raise NotImplementedError("hydromechanical mode")
    raise ValueError(f"unknown hydrology mode: {mode}")


def substrate(df: DataFrame) -> DataFrame:
    return df.withColumn("z_sub", F.col("z") - F.col("depth"))


def pga_off(df: DataFrame) -> DataFrame:
    """0 everywhere, no data included."""
    return df.withColumn("pga", F.lit(0.0))


def pga_uniform(df: DataFrame, value: float = 0.3, scaling: float = 1.0) -> DataFrame:
    """The value on cells with data, 0 on the others."""
    return df.withColumn("pga", F.when(F.col("z").isNotNull(), F.lit(value * scaling)).otherwise(0.0))


def pga_raster(df: DataFrame, pga: DataFrame, scaling: float = 1.0) -> DataFrame:
    """The raster's values on cells with data; what the reading rule drops, and no data, stay null."""
    own = pga.select("r", "c", F.when(F.col("pga") >= 0, F.col("pga")).alias("_pga"))
    return df.join(own, ["r", "c"], "left").withColumn("pga", F.when(F.col("z").isNotNull(), F.col("_pga") * scaling)).drop("_pga")


def _balance(w: Column, area: Column, u: Column, extra: Column, coh: Column, phi: Column, a: Column) -> tuple[Column, Column]:
    """Normal force and net driving force on a base of slope a."""
    sin_a, cos_a, friction = sind(a), cosd(a), tand(phi)
    normal = F.try_divide(w + u * sin_a * friction - coh * area * sin_a, cos_a + sin_a * friction)
    return normal, normal * sin_a - (coh * area + (normal - u) * friction) * cos_a + extra


def column_forces(df: DataFrame, phi: Column | float, coh: Column | float, dx: float = 10.0, dy: float = 10.0) -> DataFrame:
    """df (subdx, subdy, w, sigma_s, pga and z) with q, qx, qy, area, normal, uplift, theta, alpha, alphax, alphay.

    Cells without z stay 0; flat cells have no direction (qx, qy, theta null).
    """
    phi, coh = (x if isinstance(x, Column) else F.lit(float(x)) for x in (phi, coh))
    sx, sy = F.col("subdx"), F.col("subdy")
    m = F.sqrt(sx * sx + sy * sy)
    out = df.withColumns({"_m": m, "_a": atand(m), "_ax": atand(sx), "_ay": atand(sy)})
    ax, ay, a = F.col("_ax"), F.col("_ay"), F.col("_a")
    area = dx * dy * F.sqrt(1 - sind(ax) * sind(ax) * sind(ay) * sind(ay)) / (cosd(ax) * cosd(ay))
    out = out.withColumn("_area", area).withColumn("_u", F.col("sigma_s") * F.col("_area"))
    normal, q = _balance(F.col("w"), F.col("_area"), F.col("_u"), F.col("pga") * F.col("w"), coh, phi, a)
    out = out.withColumn("_n", normal).withColumn("_q", q)
    out = out.withColumns({"_qx": F.try_divide(-sx, F.col("_m")) * F.col("_q"), "_qy": F.try_divide(-sy, F.col("_m")) * F.col("_q")})
    made = {"q": "_q", "qx": "_qx", "qy": "_qy", "mag": "_m", "area": "_area", "normal": "_n", "uplift": "_u", "alpha": "_a", "alphax": "_ax", "alphay": "_ay"}
    on = F.col("z").isNotNull()
    return out.withColumns({k: F.when(on, F.col(v)).otherwise(0.0) for k, v in made.items()} | {"theta": F.when(on, atan2d(F.col("_qy"), F.col("_qx"))).otherwise(0.0)}).drop("_m", "_a", "_ax", "_ay", "_area", "_u", "_n", "_q", "_qx", "_qy")


def rotations(n: int = 8, spread: float = 20.0) -> list[float]:
    """Evenly spaced angles from -spread to spread."""
    return [0.0] if n == 1 else [-spread + 2 * spread * k / (n - 1) for k in range(n)]


def with_rotations(df: DataFrame, angles: list[float] | None = None) -> DataFrame:
    """A row for each cell and rotation (rot_id from 0, rot in degrees): an explode, not a join."""
    made = F.array(*(F.struct(F.lit(i).alias("rot_id"), F.lit(a).alias("rot")) for i, a in enumerate(angles or rotations())))
    return df.withColumn("_rot", F.explode(made)).select(*df.columns, "_rot.rot_id", "_rot.rot")


def project_slope(df: DataFrame, gx: str = "subdx", gy: str = "subdy") -> DataFrame:
    """df (with rot) with the gradient turned by rot and shortened by its cosine: slope, dx1, dy1."""
    length = F.sqrt(F.col(gx) * F.col(gx) + F.col(gy) * F.col(gy)) * cosd(F.col("rot"))
    turn = atan2d(F.col(gy), F.col(gx)) + F.col("rot")
    return df.withColumns({"slope1": atand(length), "dx1": length * cosd(turn), "dy1": length * sind(turn)})


def prism_forces(df: DataFrame) -> DataFrame:
    """Wedge table (gx, gy, width, reach, w, phi, coh, pressure, kw) with q, qx, qy."""
    sx, sy = F.col("gx"), F.col("gy")
    m = F.sqrt(sx * sx + sy * sy)
    ax, ay = atand(sx), atand(sy)
    area = F.col("width") * F.col("reach") * F.sqrt(1 - sind(ax) * sind(ax) * sind(ay) * sind(ay)) / (cosd(ax) * cosd(ay))
    out = df.withColumns({"_m": m, "_area": area})
    _, q = _balance(F.col("w"), F.col("_area"), F.col("pressure") * F.col("_area"), F.col("kw"), F.col("coh"), F.col("phi"), atand(F.col("_m")))
    return out.withColumn("q", q).withColumns({"qx": F.try_divide(-sx, F.col("_m")) * F.col("q"), "qy": F.try_divide(-sy, F.col("_m")) * F.col("q")}).drop("_m", "_area")


def unstable(df: DataFrame) -> DataFrame:
    """Cells with data whose net force drives them."""
    return df.where(F.col("z").isNotNull() & (F.col("q") > 0))
