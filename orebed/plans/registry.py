"""All registered queries and their SQL."""

from __future__ import annotations

from orebed.plans import graph, mining, ml, models, relational, scans, streams, tables  # noqa: F401
from orebed.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
