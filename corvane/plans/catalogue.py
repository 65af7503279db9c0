"""Every registered query of the library, by name, with the SQL that DuckDB compares it with."""

from __future__ import annotations

from corvane.plans import books, evidence, exports, links, research, retrieval, streams, texts, web

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (retrieval, texts, books, evidence, web, links, research, exports, streams):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
