"""Queries over the driver's tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .queries import assess, classify, documents, entities, joins, learning, metrics, quality, reports, retrieval, sources, summaries, text, variants, windows  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
