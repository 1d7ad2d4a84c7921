"""Registered queries over the driver tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from vellum.plans import flow_queries, page_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **page_queries.QUERIES, **flow_queries.QUERIES}
SQL: dict[str, str] = {**text_queries.SQL, **page_queries.SQL, **flow_queries.SQL}
