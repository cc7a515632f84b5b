"""Class labels from identifiers and raw targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier markers of the two classes.
CONTROL_SUFFIXES = (".C", ".CVC")
CASE_PREFIX = "LC."


def _ends_with_any(col: Column, suffixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | col.endswith(s)
    return hit


def label_suffix_lenient(col: Column, control_suffixes: Sequence[str] = CONTROL_SUFFIXES) -> Column:
    """Control suffix -> 0, any other string -> 1, null -> null. No trimming."""
    return (
        F.when(col.isNull(), F.lit(None).cast("int"))
        .when(_ends_with_any(col, control_suffixes), F.lit(0))
        .otherwise(F.lit(1))
    )


def label_suffix_strict(
    col: Column,
    control_suffixes: Sequence[str] = CONTROL_SUFFIXES,
    case_prefix: str = CASE_PREFIX,
) -> Column:
    """Trim; control suffix -> 0, case prefix -> 1, anything else -> null."""
    # Whitespace of any kind, where trim() would strip blanks only.
    t = F.regexp_replace(col, r"^\s+|\s+$", "")
    return (
        F.when(_ends_with_any(t, control_suffixes), F.lit(0))
        .when(t.startswith(case_prefix), F.lit(1))
        .otherwise(F.lit(None).cast("int"))
    )


def binarize_target(col: Column, null_policy: str = "zero") -> Column:
    """target > 0 -> 1, else 0. A null counts as 0 unless null_policy is 'keep'."""
    hit = (col > 0).cast("int")
    if null_policy == "keep":
        return hit
    if null_policy == "zero":
        return F.coalesce(hit, F.lit(0))
    raise ValueError("null_policy must be 'zero' or 'keep'")
