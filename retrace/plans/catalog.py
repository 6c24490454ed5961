"""All registered queries."""

from __future__ import annotations

from retrace.plans import report_queries, stream_queries, text_queries, time_queries  # noqa: F401  (they register)
from retrace.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
