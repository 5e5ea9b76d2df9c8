"""Queries of the library over the driver's tables, with their oracles."""

from lodestone.plans import findings_queries, retrieval_queries, source_queries, text_queries  # noqa: F401
from lodestone.plans.registry import ORACLE, QUERIES  # noqa: F401
