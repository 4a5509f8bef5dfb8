"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from folioscope.plans import article_queries, gate_queries, packet_queries, page_queries, record_queries, recovery_queries, staging_queries

_MODULES = (article_queries, record_queries, recovery_queries, staging_queries, gate_queries, page_queries, packet_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
