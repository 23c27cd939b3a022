"""Queries over the driver's tables, each with its SQL counterpart."""

from . import alert_entries, analytics_entries, detection_entries, ingest_entries, running_entries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
