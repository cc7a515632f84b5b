"""Cross-validated univariate scoring without fitting a model per fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import train_moments, with_pooled_mean
from ..operators.select import select_k_best
from ..session import join_on

FOLD = ["repeat", "fold"]


def fold_feature_table(tagged: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Per (repeat, fold, feature), from training rows of every fold in one pass:
    F, mean, population deviation and direction (+1 when positives are higher)."""
    parts = train_moments(tagged, k, [label])
    keys = [*FOLD, "feature"]
    g = with_pooled_mean(parts, keys).groupBy(*keys).agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_pooled"), 2)).alias("_between"),
        F.sum("m2").alias("_within"),
        F.sum("n").alias("_n"),
        F.count(F.lit(1)).alias("_k"),
        F.first("_pooled").alias("mean"),
        F.max(F.when(F.col(label) == 1, F.col("mean"))).alias("_m1"),
        F.max(F.when(F.col(label) == 0, F.col("mean"))).alias("_m0"),
    )
    df1, df2 = F.col("_k") - 1, F.col("_n") - F.col("_k")
    f = F.when((df1 > 0) & (df2 > 0) & (F.col("_within") > 0), (F.col("_between") / df1) / (F.col("_within") / df2))
    sd = F.sqrt((F.col("_between") + F.col("_within")) / F.col("_n"))
    return g.select(
        *keys,
        f.alias("f"),
        "mean",
        F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sd"),
        F.when(F.col("_m1") >= F.col("_m0"), F.lit(1.0)).otherwise(F.lit(-1.0)).alias("direction"),
    )


def fold_feature_scores(tagged: DataFrame, id_col: str, k: int, top: int, label: str = "label") -> DataFrame:
    """Out-of-fold score of every row: the mean signed z over the fold's `top` features
    by F. Selection, scale and direction come from training rows only."""
    chosen = select_k_best(fold_feature_table(tagged, k, label), top, FOLD)
    j = join_on(tagged, chosen.select(*FOLD, "feature", "mean", "sd", "direction"), [*FOLD, "feature"])
    z = F.col("direction") * (F.col("value") - F.col("mean")) / F.col("sd")
    return j.groupBy(*FOLD, id_col, label).agg(F.avg(z).alias("prob"))
