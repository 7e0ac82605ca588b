"""All queries of the engine but those of the subpackage llm."""

from __future__ import annotations

from .plans import answer_queries, build_queries, dialog_queries, part_queries, search_queries, text_queries  # noqa: F401  each registers its queries
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
