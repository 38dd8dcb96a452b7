"""Every registered query and its SQL."""

from __future__ import annotations

from tidemark.plans import match_queries, profile_queries, proof_queries, repair_queries  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES  # noqa: F401
