"""Queries over whole tables. Each module adds its own to queries.QUERIES, and their SQL to queries.SQL."""

from . import map_queries, retrieval_queries, source_queries  # noqa: F401
