"""Registered queries; importing the package fills the registry."""

from obscat.plans.registry import ORACLES, QUERIES  # isort: skip
from obscat.plans import (  # noqa: F401
    column_queries,
    fold_queries,
    search_queries,
    state_queries,
    stream_queries,
)

__all__ = ["ORACLES", "QUERIES"]
