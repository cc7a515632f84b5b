"""Standardising with the population standard deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import join_on


def scale_table(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation per feature; a deviation of 0 becomes 1."""
    t = long.groupBy(*by, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return t.withColumn("sd", F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd")))


def apply_scale(long: DataFrame, table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """z = (value - mean) / sd with a table fitted elsewhere."""
    j = join_on(long, table.select(*by, "feature", "mean", "sd"), [*by, "feature"])
    return j.withColumn("value", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def standardize(long: DataFrame) -> DataFrame:
    return apply_scale(long, scale_table(long))


def moments(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean and M2 (sum of squared deviations) per group."""
    return long.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"),
    )


def with_pooled_mean(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the mean over all (n, mean, m2) rows of a group: folds or classes, so few rows."""
    w = W.partitionBy(*keys)
    pooled = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    return parts.filter("n > 0").withColumn("_pooled", pooled)


def merge_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine (n, mean, m2) rows per group around the pooled mean, so nothing cancels."""
    d = with_pooled_mean(parts, keys)
    return d.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("_pooled").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_pooled"), 2)).alias("m2"),
    )


def train_moments(tagged: DataFrame, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """(n, mean, m2) per (repeat, fold, feature, extra...) over training rows, for all folds at once.

    `tagged` is the long form with the row's own test fold per repeat. It is aggregated
    once per repeat; a fold's training moments are the merge of the other folds'
    moments, a table of features x folds rows.
    """
    per_fold = moments(tagged, ["repeat", "fold", "feature", *extra])
    folds = F.array(*[F.lit(i) for i in range(k)])
    others = F.array_except(folds, F.array(F.col("fold").cast("int")))
    return merge_moments(per_fold.withColumn("fold", F.explode(others)), ["repeat", "fold", "feature", *extra])


def train_scale_table(train: DataFrame) -> DataFrame:
    """Scale table per (repeat, fold, feature) from train_moments."""
    sd = F.sqrt(F.col("m2") / F.col("n"))
    return train.select("repeat", "fold", "feature", "mean", F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sd"))
