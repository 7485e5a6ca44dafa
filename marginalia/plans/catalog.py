"""All named queries of this library with their DuckDB text."""

from marginalia.plans import feature_queries, graph_queries, link_queries, quality_queries, search_queries, stream_queries, text_queries  # noqa: F401  registers them
from marginalia.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
