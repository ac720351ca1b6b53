"""All registered queries."""

from albumetry.plans import group_queries, library_queries, search_queries  # noqa: F401
from albumetry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
