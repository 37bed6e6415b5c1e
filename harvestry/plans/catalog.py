"""Registered queries and their DuckDB counterparts."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
