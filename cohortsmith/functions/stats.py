"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 26.2.17, |error| < 7.5e-8.
TAIL_SCALE = 0.2316419
TAIL_COEFFICIENTS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(TAIL_SCALE) * a)
    poly = F.lit(0.0)
    for c in reversed(TAIL_COEFFICIENTS):
        poly = (poly + F.lit(c)) * t
    upper = F.exp(-a * a / 2.0) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """num/den with a default for a zero denominator."""
    return F.when(den == 0, F.lit(default)).otherwise(num.cast("double") / den.cast("double"))
