"""All queries of the library's own operators."""

from __future__ import annotations

from lexmill.plans import derived, more, relational, rest, retrieval, streams, texts  # noqa: F401
from lexmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
