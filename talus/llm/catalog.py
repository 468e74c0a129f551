"""All queries of this subpackage and the SQL that states the same, where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "toxicity", "mixing", "quality", "htmltext", "linededup", "lm", "simhash", "secrets", "decontamination")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"talus.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"talus.llm.{m}").ORACLES.items()}
