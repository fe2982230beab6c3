"""Registered queries, one per operator, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import elements, geometry, relations, runs, scalars, sources
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "elements", "geometry", "relations", "runs", "scalars", "sources"]
