"""Every registered query of the book operators."""

from bookengine.plans import book_queries, fb2_queries, join_queries, markup_queries, mixed_queries, scalar_queries, structure_queries  # noqa: F401
from bookengine.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
