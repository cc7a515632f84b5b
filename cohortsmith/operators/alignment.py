"""Bringing two tables together, by key or by position, and comparing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import join_on
from .ranking import bucket_bounds


def number_rows(df: DataFrame, order_col: str, out: str = "position") -> DataFrame:
    """1-based position by a unique numeric column. Range buckets carry the work; only
    the bucket sizes meet in one task."""
    cut = Bucketizer(splits=bucket_bounds(df, order_col), inputCol="_k", outputCol="_b", handleInvalid="keep")
    d = cut.transform(df.withColumn("_k", F.col(order_col).cast("double"))).drop("_k")
    sizes = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.select("_b", (F.sum("_n").over(upto) - F.col("_n")).alias("_off"))
    local = d.withColumn("_rn", F.row_number().over(W.partitionBy("_b").orderBy(order_col)))
    # Every row has a bucket, so a plain join keeps the window's partitioning.
    return local.join(offsets, "_b").withColumn(out, F.col("_off") + F.col("_rn")).drop("_b", "_rn", "_off")


def align_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Row i of one table with row i of the other, cut at the shorter one.

    Only for tables that share an order; unrelated tables get labels of other rows.
    """
    a, b = number_rows(left, left_order), number_rows(right, right_order)
    return join_on(a, b, ["position"])


def align_by_id(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Every left row with the right row of the same id, or nulls."""
    return left.join(right, left[left_id] == right[right_id], "left")


def unmatched(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Left rows without a partner."""
    return left.join(right.select(right_id), left[left_id] == right[right_id], "left_anti")


def compare_sources(parts: dict[str, DataFrame], model: str, metrics: Sequence[str]) -> DataFrame:
    """One row per model, one column per (source, metric)."""
    stacked = None
    for name, d in parts.items():
        row = d.select(F.lit(name).alias("source"), model, *metrics)
        stacked = row if stacked is None else stacked.unionByName(row)
    # Two or more aggregates make Spark name the columns <source>_<metric>.
    aggs = [F.first(m).alias(m) for m in metrics]
    out = stacked.groupBy(model).pivot("source", sorted(parts)).agg(*aggs)
    if len(metrics) == 1:
        out = out.select(model, *[F.col(s).alias(f"{s}_{metrics[0]}") for s in sorted(parts)])
    return out


def keep_labeled(df: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """Rows whose id has a label in the other table."""
    valid = labels.filter(F.col(label).isNotNull()).select(id_col)
    return df.join(valid, id_col, "left_semi")
