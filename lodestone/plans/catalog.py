"""All registered queries over the supplied tables."""

from lodestone.plans import gates, items, quality, relations, retrieval  # noqa: F401  importing registers
from lodestone.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
