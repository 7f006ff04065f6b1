"""The named queries over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from . import chat_queries, ingest_queries, ops_queries, records_queries, retrieval_queries, stream_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (retrieval_queries, ingest_queries, chat_queries, ops_queries, records_queries, stream_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
