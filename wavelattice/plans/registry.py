"""All core queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from wavelattice.plans import checks, combined, dynamics, extras, models, preparation, relations, visibility

MODULES = (visibility, dynamics, relations, models, extras, combined, checks, preparation)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
