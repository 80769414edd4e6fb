"""All registered queries: importing this module registers every family."""

from __future__ import annotations

from cohortflow.plans import registry
from cohortflow.plans import q_clean, q_repair, q_metrics, q_more, q_models  # noqa: F401  (registration side effects)

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
