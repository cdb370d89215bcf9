"""The registered queries: each runs over the driver's whole tables."""

from __future__ import annotations

from threadloom.catalog import (
    comment_queries, engagement_queries, ingest_queries, topic_queries, vector_queries)

MODULES = (ingest_queries, comment_queries, topic_queries, engagement_queries, vector_queries)


def all_queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
