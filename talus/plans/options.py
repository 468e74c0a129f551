"""Options of a regional run, checked before anything is read."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

# Where depth and no-grow lines come from.
DEPTH_SOURCES, NOGROW_SOURCES = ("uniform", "mat", "compute"), ("none", "mat", "compute", "units")


@dataclass
class Options:
    """run_index counts from 0; None runs all strengths."""

    depth_source: str = "uniform"
    depth_file: str | None = None
    nogrow_source: str = "none"
    nogrow_file: str | None = None
    units_file: str | None = None
    strength_file: str | None = None
    uniform_strength: bool = True
    run_index: int | None = None
    aggregate: bool = False

    def problems(self, n_runs: int | None = None) -> list[str]:
        """What is wrong with these options, all at once; n_runs: how many strengths there are, once known."""
        out = []
        if self.depth_source not in DEPTH_SOURCES:
            out.append(f"depth_source must be one of {', '.join(DEPTH_SOURCES)}")
        if self.nogrow_source not in NOGROW_SOURCES:
            out.append(f"nogrow_source must be one of {', '.join(NOGROW_SOURCES)}")
        if self.run_index is not None:
            if self.run_index < 0:
                out.append("run_index counts from 0")
            elif n_runs is not None and self.run_index >= n_runs:
                out.append(f"run_index {self.run_index} is beyond the {n_runs} strengths")
            if self.aggregate:
                out.append("aggregate needs runs that are done: run_index goes without it")
        if not self.aggregate:  # the map of banked runs reads none of these
            if self.depth_source == "mat" and not self.depth_file:
                out.append("depth_source mat needs depth_file")
            if self.nogrow_source == "mat" and not self.nogrow_file:
                out.append("nogrow_source mat needs nogrow_file")
            if self.nogrow_source == "units" and not self.units_file:
                out.append("nogrow_source units needs units_file")
            if not self.uniform_strength and not self.strength_file:
                out.append("strengths other than a uniform one need strength_file")
        return out

    def check(self, n_runs: int | None = None) -> None:
        if found := self.problems(n_runs):
            raise ValueError("; ".join(found))


def stamped(line: str, at: datetime | None = None) -> str:
    """A log line with its time to the second, as progress lines carry it."""
    return f"{(at or datetime.now()):%Y-%m-%d %H:%M:%S} {line}"
