"""The registered queries."""

from . import record_queries, search_queries, table_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "record_queries", "search_queries", "table_queries", "text_queries"]
