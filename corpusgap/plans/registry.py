"""Every query of the library proper, with its SQL twin over the same tables."""

from __future__ import annotations

from . import feed_queries, gap_queries, report_queries, source_queries  # noqa: F401  (they register their queries)
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
