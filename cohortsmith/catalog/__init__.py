"""Registered queries over the driver tables, each with its SQL twin where SQL can say it."""

from . import cleaning, comparing, evaluating, modelling, profiling, rebalancing, selecting, splitting  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
