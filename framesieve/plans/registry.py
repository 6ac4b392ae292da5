"""All registered queries of the library proper, with the SQL they are checked against."""

from __future__ import annotations

from framesieve.plans import header_queries, pixel_queries, session_queries, star_queries, table_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (session_queries, header_queries, pixel_queries, star_queries, table_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
