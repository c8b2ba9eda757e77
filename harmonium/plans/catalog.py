"""All registered queries."""

from __future__ import annotations

from harmonium.plans import (  # noqa: F401  (registration)
    feature_queries,
    matching_queries,
    profile_queries,
    recommend_queries,
    relational_queries,
)
from harmonium.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
