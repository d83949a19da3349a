"""Operators on text and vectors for preparing training data; nothing else in the package uses them."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
