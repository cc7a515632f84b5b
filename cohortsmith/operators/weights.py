"""Row weights and resampling sizes for unbalanced classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import join_on


def weight_table(df: DataFrame, label: str = "label") -> DataFrame:
    """w = n / (classes * n_class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(1))
    total, classes = F.sum("n").over(every), F.count(F.lit(1)).over(every)
    return c.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    return join_on(df, weight_table(df, label).select(label, "weight"), [label])


def weigh_for_fit(df: DataFrame, label: str = "label") -> tuple[DataFrame, float]:
    """balanced_weights with the sum of the weights, which a penalty needs."""
    total = weight_table(df, label).agg(F.sum(F.col("n") * F.col("weight"))).first()[0]
    return balanced_weights(df, label), float(total or 0.0)


def cost_weights(df: DataFrame, ratio: float = 20.0, label: str = "label") -> DataFrame:
    """Fixed cost of the positive class against 1 for the negative."""
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def safe_k(audit: DataFrame, largest: int = 3) -> DataFrame:
    """Neighbour counts a fold can support: 1..min(largest, minority-1); none below two minority rows."""
    cap = F.least(F.lit(largest), F.col("n_minority_train") - 1).cast("int")
    k = F.when(F.col("n_minority_train") >= 2, cap).otherwise(F.lit(0))
    return audit.withColumn("max_k", k).withColumn("resample", F.col("n_minority_train") >= 2)
