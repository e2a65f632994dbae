"""All queries of the engine and their SQL."""

from __future__ import annotations

from quillmark.plans import document_queries, graph_queries, ingest_queries, parse_queries, record_queries, search_queries, walk_queries

MODULES = (ingest_queries, document_queries, search_queries, graph_queries, record_queries, walk_queries, parse_queries)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}
