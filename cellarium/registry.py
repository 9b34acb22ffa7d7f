"""All queries of the cube engine, by name, and the SQL they are held against."""

from __future__ import annotations

from cellarium.queries import base, solving  # noqa: F401  registers the queries
from cellarium.queries.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
