"""Operators for preparing training text; nothing else in the library imports this subpackage."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
