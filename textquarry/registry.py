"""Registered queries of the engine and their SQL."""

from textquarry.plans import catalogue2, catalogue3  # noqa: F401  register their queries
from textquarry.plans.catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
