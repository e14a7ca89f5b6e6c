"""Registered queries of the tracking engine and their SQL."""

from .plans import streams as _streams  # noqa: F401  registers the streaming queries
from .plans.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
