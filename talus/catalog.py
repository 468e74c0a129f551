"""All queries of the terrain engine by name, and the SQL that states the same where SQL can."""

from __future__ import annotations

from talus.queries import files, fixtures, global_, surface  # noqa: F401  (they register their queries)

QUERIES, ORACLES = fixtures.QUERIES, fixtures.ORACLES
