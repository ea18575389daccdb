"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from .queries import audits, catalogue, files, fragments, holdouts, sketching
from .queries.common import ORACLES, QUERIES

FAMILIES = (catalogue, holdouts, fragments, sketching, audits, files)

__all__ = ["FAMILIES", "ORACLES", "QUERIES"]
