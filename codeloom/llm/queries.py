"""All queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from codeloom.llm import code_queries, text_queries

_MODULES = (code_queries, text_queries)
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
