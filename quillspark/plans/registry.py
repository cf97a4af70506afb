"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import catalog_queries, dialect_queries, engine_queries, function_queries, source_queries

MODULES = (catalog_queries, function_queries, dialect_queries, engine_queries, source_queries)  # each adds its own when it is imported
QUERIES, ORACLE = catalog_queries.QUERIES, catalog_queries.ORACLE
