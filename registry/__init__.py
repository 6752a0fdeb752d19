"""Registered queries with their DuckDB counterparts, over the given tables."""

from registry.base import ORACLES, QUERIES
from registry import curation, enrichment, landing, merge_history, publishing, storage, streams, texts  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
