"""Every registered query of the record-linkage operators and its SQL."""

from __future__ import annotations

from tessera.plans import decisions, pairs, records  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
