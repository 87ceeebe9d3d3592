"""Registered queries: one per operator, over the driver tables."""

from lotweave.queries import aggregates, geometry, joins, models, plans, ranking, rules, sources, state, texts  # noqa: F401
from lotweave.queries.registry import ORACLES, QUERIES  # noqa: F401
