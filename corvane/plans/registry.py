"""All registered queries of the library and their DuckDB statements."""

from __future__ import annotations

from corvane.plans import mining  # noqa: F401  registers its queries
from corvane.plans.relational import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
