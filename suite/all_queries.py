"""All registered queries in one place."""

from suite import catalog_queries, recommend_queries, search_queries, stream_queries, text_queries  # noqa: F401
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
