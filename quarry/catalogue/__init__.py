"""Registered queries: each operator over whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from quarry.catalogue import code, relations, search, stored, textual
from quarry.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code", "relations", "search", "stored", "textual"]
