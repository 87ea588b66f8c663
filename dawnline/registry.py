"""All registered queries of the library, with the SQL of those that SQL can express."""

from __future__ import annotations

from dawnline.plans import daily_queries, detail_queries, event_queries, html_queries, page_queries, reader_queries, report_queries, selection_queries, state_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (text_queries, report_queries, event_queries, page_queries, html_queries, state_queries, daily_queries, selection_queries, reader_queries, detail_queries):
    QUERIES |= _module.R.queries
    ORACLE_SQL |= _module.R.sql
