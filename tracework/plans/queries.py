"""All registered queries."""

from __future__ import annotations

from . import catalog_queries, learn_queries, metric_queries, spatial_queries, trace_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
