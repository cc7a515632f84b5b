"""Grouped reports over fold records, features and configurations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

# Metrics of a fold record, in report order.
FOLD_METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision")


def summarize_folds(folds: DataFrame, by: Sequence[str], metrics: Sequence[str] = FOLD_METRICS) -> DataFrame:
    """Mean and sample deviation per metric."""
    aggs = [F.count(F.lit(1)).alias("folds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd")]
    return folds.groupBy(*by).agg(*aggs)


def summarize_ok_folds(folds: DataFrame, by: Sequence[str], metrics: Sequence[str], note: str = "note") -> DataFrame:
    """The same over folds marked ok, next to the number of all folds."""
    ok = F.col(note) == "ok"
    aggs = [F.count(F.lit(1)).alias("n_folds_total"), F.count(F.when(ok, 1)).alias("n_folds_with_positives")]
    for m in metrics:
        v = F.when(ok, F.col(m))
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_std")]
    return folds.groupBy(*by).agg(*aggs)


def metric_summary_long(folds: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per (group, metric) with mean and sample deviation."""
    long = folds.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(by), list(metrics), "metric", "value"
    )
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def stack_folds(parts: Sequence[DataFrame]) -> DataFrame:
    """All fold records under each other; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def feature_stability(selected: DataFrame, n_folds: int, by: Sequence[str] = ()) -> DataFrame:
    """How many folds chose a feature. Input: one row per (fold, feature)."""
    c = selected.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("selection_count"))
    return c.withColumn("selection_frequency", F.col("selection_count") / F.lit(n_folds))


def order_stability(stability: DataFrame) -> DataFrame:
    return stability.orderBy(F.desc("selection_frequency"), F.desc("selection_count"), F.asc("feature"))


def top_features(importance: DataFrame, k: int = 15, by: Sequence[str] = (), value: str = "importance") -> DataFrame:
    """The k most important features per model, ties by name."""
    return top_k(importance, k, [F.col(value).desc_nulls_last(), F.asc("feature")], by)


def best_model(table: DataFrame, metric: str = "roc_auc", order: str = "position", name: str = "model") -> DataFrame:
    """The model with the highest metric; on ties the one listed first."""
    key = F.struct(F.col(metric), (-F.col(order)).alias("_first"))
    return table.filter(F.col(metric).isNotNull()).agg(
        F.max_by(F.col(name), key).alias(name), F.max(metric).alias(metric)
    )


def leaderboard(table: DataFrame, by: Sequence[str], metric: str, n: int) -> DataFrame:
    """Mean of a metric per configuration, best n, ties by name."""
    g = table.groupBy(*by).agg(F.avg(metric).alias(f"{metric}_mean"))
    return g.orderBy(F.col(f"{metric}_mean").desc_nulls_last(), *[F.asc(c) for c in by]).limit(n)


def fold_counts_by_class(split: DataFrame, label: str = "label", role: str = "role") -> DataFrame:
    return split.groupBy(role, label).agg(F.count(F.lit(1)).alias("n"))


def format_mean_sd(mean: Column, sd: Column) -> Column:
    """'0.9971 ± 0.0057', or 'N/A' when there is no mean."""
    text = F.format_string("%.4f ± %.4f", mean, F.coalesce(sd, F.lit(0.0)))
    return F.when(mean.isNull() | F.isnan(mean), F.lit("N/A")).otherwise(text)


def run_metadata(df: DataFrame, n_features: int, settings: dict, label: str = "label") -> DataFrame:
    """One row: sample counts, width and the settings of a run."""
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("n_neg"),
    ).select(
        "n_samples",
        F.lit(int(n_features)).cast("long").alias("n_features_after_filter"),
        "n_pos",
        "n_neg",
        *[F.lit(v).alias(k) for k, v in settings.items()],
    )
