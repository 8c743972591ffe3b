"""All queries of the core, with their SQL."""

from __future__ import annotations

from earshot.plans import interval_queries, quality_queries, search, search_queries, segment_queries, text_queries

MODULES = [text_queries, search_queries, search, segment_queries, quality_queries, interval_queries]
FLAGSHIP = "bm25_topk"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
