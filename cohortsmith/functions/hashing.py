"""Deterministic pseudo-randomness from md5, stable under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(p) -> Column:
    return p.cast("string") if isinstance(p, Column) else F.lit(str(p))


def digest(*parts) -> Column:
    """md5 hex of the parts joined with ':'."""
    return F.md5(F.concat_ws(":", *[_part(p) for p in parts]))


def hash_int(*parts) -> Column:
    """First 15 hex digits of the digest as an integer in [0, 2^60): far beyond any group's size,
    so a draw modulo the size reaches every row about equally often."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("long")


def hash_unit(*parts) -> Column:
    """Uniform value in [0, 1)."""
    return hash_int(*parts).cast("double") / F.lit(float(1 << 60))
