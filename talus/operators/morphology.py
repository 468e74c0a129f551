"""Binary morphology: one pass as a relational stencil, chains of passes on tiles with halos."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators.focal import WEIGHTS, code
from talus.plans.tiles import SIZE, tiled

_RING = ("n", "ne", "e", "se", "s", "sw", "w", "nw")  # clockwise
Hood = dict[str, bool]


def build_lut(rule: Callable[[Hood], bool]) -> list[bool]:
    """New centres for all 512 neighbourhood codes; rule gets the cells by side ("" is the centre)."""
    return [bool(rule({s: bool(k & w) for s, w in WEIGHTS.items()})) for k in range(512)]


def _set(h: Hood) -> int:
    return sum(h[s] for s in _RING)


def _groups(h: Hood) -> int:
    """Groups of set ring cells; a corner cell joins its two sides, and the sides beside a corner touch."""
    order = [h[s] for s in _RING]
    if all(order):
        return 1
    # gaps that part groups: an unset side, or both ... a lone unset corner between two set sides does not
    solid = [order[i] or (i % 2 == 1 and order[i - 1] and order[(i + 1) % 8]) for i in range(8)]
    if all(solid):
        return 1
    return sum(solid[i] and not solid[i - 1] for i in range(8))


def _corner(h: Hood) -> bool:
    return any(h[a] and h[b] and not h[a + b] for a in "ns" for b in "we")


def _thin(first: bool) -> Callable[[Hood], bool]:
    def rule(h: Hood) -> bool:
        if not h[""]:
            return False
        order = [h[s] for s in _RING]
        turns = sum(not order[i] and order[(i + 1) % 8] for i in range(8))
        n, e, s, w = h["n"], h["e"], h["s"], h["w"]
        open_sides = (not (n and e and s) and not (e and s and w)) if first else (not (n and e and w) and not (n and s and w))
        return not (2 <= _set(h) <= 6 and turns == 1 and open_sides)

    return rule


RULES: dict[str, list[Callable[[Hood], bool]]] = {
    "clean": [lambda h: h[""] and _set(h) > 0],
    "fill": [lambda h: h[""] or _set(h) == 8],
    "majority": [lambda h: h[""] + _set(h) >= 5],
    "spur": [lambda h: h[""] and _set(h) > 1],
    "bridge": [lambda h: h[""] or _groups(h) >= 2],
    "diag": [lambda h: h[""] or _corner(h)],
    "skel": [_thin(True), _thin(False)],
}
LUTS = {op: [build_lut(r) for r in rules] for op, rules in RULES.items()}


def once(df: DataFrame, op: str, mask: str = "mask") -> DataFrame:
    """df with its mask after one iteration of ``op``, as windows and a look-up."""
    if op not in LUTS:
        raise ValueError(f"unknown operation: {op!r}")
    for lut in LUTS[op]:
        df = code(df, mask).withColumn(mask, F.element_at(F.lit(lut), F.col("code") + 1)).drop("code")
    return df


def run_pass(bits: np.ndarray, lut: list[bool]) -> np.ndarray:
    p = np.pad(bits, 1)
    m, n = bits.shape
    at = {"nw": (0, 0), "w": (1, 0), "sw": (2, 0), "n": (0, 1), "": (1, 1), "s": (2, 1), "ne": (0, 2), "e": (1, 2), "se": (2, 2)}
    total = np.zeros(bits.shape, np.int64)
    for s, (i, j) in at.items():
        total += WEIGHTS[s] * p[i : i + m, j : j + n]
    return np.array(lut)[total]


def chain(df: DataFrame, steps: list[tuple[str, int]], mask: str = "mask", size: int = SIZE) -> DataFrame:
    """(r, c, mask) after the iterations of ``steps`` in turn: one exchange, the halo as wide as the passes are many."""
    luts = [lut for op, k in steps for _ in range(k) for lut in LUTS[op]]

    def kernel(grid: dict, place: dict) -> dict:
        bits = np.nan_to_num(grid[mask]) > 0
        for lut in luts:
            bits = run_pass(bits, lut) & place["inside"]
        return {"_out": bits}

    return tiled(df, [mask], kernel, "_out boolean", max(1, len(luts)), size).withColumnRenamed("_out", mask)


def until_stable(df: DataFrame, op: str, most: int = 200, mask: str = "mask", block: int = 16, size: int = SIZE) -> DataFrame:
    """(r, c, mask) after ``most`` iterations of op, or as many as change something; ``block`` iterations an exchange."""
    from talus.plans.checkpoints import cut

    now, done = cut(df.select("r", "c", F.coalesce(F.col(mask), F.lit(False)).alias(mask))), 0
    while done < most:
        k = min(block, most - done)
        new = cut(chain(now, [(op, k)], mask, size))
        same = not new.exceptAll(now).limit(1).count()
        now, done = new, done + k
        if same:
            break
    return now


def cleanup(df: DataFrame, rounds: int = 5, least: int = 7, nogrow: DataFrame | None = None, mask: str = "mask") -> DataFrame:
    """Initial clean-up of unstable cells: the chain, no-grow cells cleared, small components dropped. Not masked by validity."""
    from talus.operators.labels import area_open

    return area_open(passed(df, rounds, nogrow, mask), least, mask)


def passed(df: DataFrame, rounds: int = 5, nogrow: DataFrame | None = None, mask: str = "mask") -> DataFrame:
    """The clean-up without the size of components."""
    order = ("spur", "bridge", "fill", "majority", "spur", "clean", "spur")
    out = chain(df, [(op, rounds) for op in order], mask)
    if nogrow is not None:
        out = out.join(nogrow.select("r", "c").distinct().withColumn("_no", F.lit(True)), ["r", "c"], "left").withColumn(mask, F.col(mask) & F.col("_no").isNull()).drop("_no")
    return out


def thinned(df: DataFrame, mask: str = "mask") -> DataFrame:
    """No-grow lines: skeleton, then bridge and diag once each."""
    return chain(until_stable(df, "skel", 200, mask), [("bridge", 1), ("diag", 1)], mask)


def reconstruct(df: DataFrame, marker: str, limit: str) -> DataFrame:
    """df's grid with ``rebuilt``: grey-scale reconstruction of marker by dilation under limit."""
    from talus.plans.tiles import fixpoint

    def kernel(grid: dict, place: dict) -> dict:
        now, cap = np.where(np.isnan(grid["rebuilt"]), -np.inf, grid["rebuilt"]), grid[limit]
        while True:
            p = np.pad(now, 1, constant_values=-np.inf)
            high = np.max([p[i : i + now.shape[0], j : j + now.shape[1]] for i in range(3) for j in range(3)], axis=0)
            new = np.where(np.isnan(cap), now, np.minimum(high, cap))
            new[[0, -1]], new[:, [0, -1]] = now[[0, -1]], now[:, [0, -1]]
            if (new == now).all():
                return {"_new": np.where(np.isinf(now), np.nan, now)}
            now = new

    start = df.select("r", "c", F.col(limit), F.least(marker, limit).alias("rebuilt"))
    return fixpoint(start, [limit], "rebuilt", kernel)
