"""The registered queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

from . import audit_queries, detail_queries, evaluation_queries, window_queries

QUERIES: dict = audit_queries.QUERIES | window_queries.QUERIES | evaluation_queries.QUERIES | detail_queries.QUERIES
ORACLE_SQL: dict = audit_queries.ORACLE_SQL | window_queries.ORACLE_SQL | evaluation_queries.ORACLE_SQL | detail_queries.ORACLE_SQL
FLAGSHIP = "audit_counts_by_state"
