"""All named queries and the SQL that must give the same rows."""

from __future__ import annotations

from retort.plans import domain, learning, relations, scalars

QUERIES = scalars.plans.queries | relations.plans.queries | learning.plans.queries | domain.plans.queries
ORACLES = scalars.plans.oracles | relations.plans.oracles | learning.plans.oracles | domain.plans.oracles
