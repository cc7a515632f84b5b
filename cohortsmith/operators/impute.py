"""Filling missing cells, with statistics from all rows or from training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import fill_zero, nan_to_null
from ..session import join_on
from .median import exact_median


def missing_report(long: DataFrame) -> DataFrame:
    """Missing cells per feature."""
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"),
    )


def fill_zero_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: fill_zero(F.col(f"`{c}`")) for c in columns})


# The clinical fields in use.
CLINICAL_FIELDS = ("x0_Age", "x0_BMI", "x0_Sample_Minutes", "x0_Cortisol", "x0_Sex")


def clinical_features(df: DataFrame, id_col: str, fields: Sequence[str] = CLINICAL_FIELDS) -> DataFrame:
    """The clinical fields as double, missing as 0."""
    return df.select(id_col, *[fill_zero(F.col(f"`{c}`")).alias(c) for c in fields])


def median_table(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact median per feature; features without a valid cell are absent."""
    return exact_median(long, "value", [*by, "feature"])


def median_fill(
    long: DataFrame,
    medians: DataFrame,
    by: Sequence[str] = (),
    empty_as: float | None = 0.0,
) -> DataFrame:
    """value -> median of its feature -> `empty_as` when the feature has none.

    `medians` may come from other rows (a training fold, a saved table) and is never refitted.
    """
    joined = join_on(long, medians.select(*by, "feature", "median"), [*by, "feature"], "left")
    choices = [nan_to_null(F.col("value")), F.col("median")]
    if empty_as is not None:
        choices.append(F.lit(empty_as))
    return joined.withColumn("value", F.coalesce(*choices)).drop("median")


def train_medians(tagged: DataFrame, k: int) -> DataFrame:
    """Median per (repeat, fold, feature) over that fold's training rows.

    `tagged` is the long form with the row's own test fold per repeat. Folds are counted once and
    the counts of the other folds are added up; no row is copied.
    """
    return exact_median(tagged, "value", ["repeat", "feature"], leave_out="fold", parts=k).select("repeat", "fold", "feature", "median")
