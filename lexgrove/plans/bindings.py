"""Queries over the driver's tables, with their reference SQL."""

from __future__ import annotations

from . import layout_queries, source_queries, term_queries, text_queries

PARTS = (term_queries, text_queries, layout_queries, source_queries)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
