"""Imports every query module so that the registry is full."""

from __future__ import annotations

from . import q_columns, q_convert, q_corrections, q_grouping, q_joins, q_ml, q_quality, q_relations, q_stats, q_stream, q_templates  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
