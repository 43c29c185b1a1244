"""Named queries over the driver tables and the SQL that they are checked against."""

from __future__ import annotations

from needledrop.plans import catalog_queries, evaluate_queries, match_queries, signal_queries, stream_queries, sync_queries  # noqa: F401
from needledrop.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
