"""All queries over the analytics operators, with the SQL they are checked against."""

from __future__ import annotations

from . import diagnostic_queries, document_queries, evaluation_queries, interval_queries, state_queries, text_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (interval_queries, text_queries, evaluation_queries, state_queries, diagnostic_queries, document_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
