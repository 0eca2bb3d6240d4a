"""Registry of the engine's own queries and their DuckDB oracles."""

from __future__ import annotations

from photonlake.plans import browse, groups, records, scalars, similarity, upkeep

_FAMILIES = [browse, groups, similarity, scalars, upkeep, records]
QUERIES: dict = {name: f for family in _FAMILIES for name, f in family.QUERIES.items()}
ORACLES: dict = {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
