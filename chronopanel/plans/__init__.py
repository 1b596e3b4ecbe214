"""All registered queries of the panel engine."""

from . import aggregate_queries, extension_queries, inference_queries, join_queries, price_queries, source_queries, split_queries, table_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
