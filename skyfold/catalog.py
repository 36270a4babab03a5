"""The registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from skyfold.plans import corrections, files, frames, imaging, live, matching, neighbourhood, panels, stacking, stars, targets, tiled

FLAGSHIP = "stack_sigma_clip"
_MODULES = (stacking, frames, matching, imaging, neighbourhood, stars, targets, corrections, files, live, tiled, panels)
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
