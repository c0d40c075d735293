"""All core queries by name."""

from __future__ import annotations

from marquetry.functions import scalars
from marquetry.plans import catalogue, credits, entities, lookups, matching, resolve, special, store, training
from marquetry.plans.sql import register

_TEXTS = {name: scalars.query_text(name) for name in scalars.SCALARS} | store.TEXTS | resolve.TEXTS | credits.TEXTS | entities.TEXTS
_QUERIES, _ORACLE = register(_TEXTS)

QUERIES = training.QUERIES | _QUERIES | special.QUERIES | matching.QUERIES | catalogue.QUERIES | lookups.QUERIES
ORACLE = training.ORACLE | _ORACLE | special.ORACLE | matching.ORACLE | catalogue.ORACLE | lookups.ORACLE
FLAGSHIP = "consolidate"
