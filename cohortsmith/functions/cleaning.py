"""Text cells to numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "missing".
MISSING_TOKENS = ("NaN;", "NaN", "nan", "", " ")

# Plain decimal or scientific notation; keeps out 1d, 2f, Infinity, NaN and 1_000.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def sentinel_to_null(col: Column) -> Column:
    """Exact match with a missing token -> null."""
    return F.when(col.isin(*MISSING_TOKENS), F.lit(None).cast("string")).otherwise(col)


def contains_nan_to_null(col: Column) -> Column:
    """Text that holds 'NaN' anywhere, or is blank -> null."""
    blank = F.trim(col) == ""
    return F.when(col.contains("NaN") | blank, F.lit(None).cast("string")).otherwise(col)


def to_double_coerce(col: Column) -> Column:
    """Parse a number; whatever does not parse becomes null, never NaN or infinity."""
    t = F.trim(col)
    v = F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def clean_numeric(col: Column) -> Column:
    """The usual chain: missing tokens to null, then coerce."""
    return to_double_coerce(sentinel_to_null(col))


def nan_to_null(col: Column) -> Column:
    """Spark aggregates treat NaN as a value; a missing cell must be null."""
    return F.when(~F.isnan(col), col)


def fill_zero(col: Column) -> Column:
    return F.coalesce(nan_to_null(col.cast("double")), F.lit(0.0))
