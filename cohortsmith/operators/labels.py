"""Row filters and counts around the class label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import safe_div


def drop_unlabeled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # The window sees one row per class.
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.select(label, "n", (F.col("n") / total).alias("share"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: counts, prevalence, negatives per positive, and the Brier score of a
    constant forecast at the prevalence."""
    pos = F.count(F.when(F.col(label) == 1, 1))
    agg = df.agg(F.count(F.lit(1)).alias("n"), pos.alias("n_pos"))
    p = safe_div(F.col("n_pos"), F.col("n"))
    neg = F.col("n") - F.col("n_pos")
    return agg.select(
        "n",
        "n_pos",
        neg.alias("n_neg"),
        p.alias("prevalence"),
        safe_div(neg, F.col("n_pos")).alias("neg_per_pos"),
        (p * (1 - p)).alias("brier_baseline"),
    )


def require_two_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """Fail unless two or more labels occur. min <> max needs no distinct."""
    lo, hi = df.agg(F.min(label), F.max(label)).first()
    if lo is None or lo == hi:
        raise ValueError(f"column {label!r} holds fewer than two classes")
    return df


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Counts per raw target value, nulls left out, in value order."""
    return (
        df.filter(F.col(target).isNotNull())
        .groupBy(target)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(target)
    )
