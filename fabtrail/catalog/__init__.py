"""Registered queries, by area."""

from fabtrail.catalog.base import ORACLE, QUERIES
from fabtrail.catalog import formats, reads, rules, tables  # noqa: F401  (registers)

__all__ = ["ORACLE", "QUERIES"]
