"""Every registered query of the engine, and its SQL twin."""

from __future__ import annotations

from .queries import exchange, generated, pages, tables

QUERIES: dict = {**pages.QUERIES, **tables.QUERIES, **generated.QUERIES, **exchange.QUERIES}
ORACLE_SQL: dict = {**pages.ORACLE_SQL, **tables.ORACLE_SQL, **generated.ORACLE_SQL, **exchange.ORACLE_SQL}
