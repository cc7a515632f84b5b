"""Contribution of each feature to a linear score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_on


def linear_attribution(long: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Mean over rows of |coefficient * (value - feature mean)|.

    coefficients: feature, coefficient. Their table has one row per feature.
    """
    means = long.groupBy("feature").agg(F.avg("value").alias("_mean"))
    small = join_on(coefficients.select("feature", "coefficient"), means, ["feature"])
    j = join_on(long, small, ["feature"])
    part = F.abs(F.col("coefficient") * (F.col("value") - F.col("_mean")))
    return j.groupBy("feature").agg(F.avg(part).alias("importance"))
