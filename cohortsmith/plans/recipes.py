"""Fitted column recipes: which features a fold uses and how it fills and scales them.

A recipe is a small table (feature, rank, fill, mean, sd) learned from training rows.
Recipes of all folds come from one pass; applying one is a plain projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.impute import train_medians
from ..operators.scale import merge_moments, train_moments, with_pooled_mean
from ..operators.select import select_k_best
from ..session import join_on

FOLD = ["repeat", "fold"]


def fold_recipes(tagged: DataFrame, k: int, top: int, label: str = "label", impute: bool = True) -> DataFrame:
    """Top features by F of every (repeat, fold), after median filling, with fill, mean and sd.

    `tagged` is the long form (repeat, fold, label, feature, value). Filling a training
    set with its median adds a point mass to the moments of each class, so the filled
    rows never have to be made.
    """
    keys = [*FOLD, "feature"]
    seen = train_moments(tagged, k, [label])
    if impute:
        flag = F.when(F.col("value").isNull(), F.lit(1.0))
        gaps = train_moments(tagged.withColumn("value", flag), k, [label]).select(*keys, label, "n")
        medians = train_medians(tagged, k)
        mass = join_on(gaps, medians, keys, "left").select(
            *keys, label, "n", F.coalesce("median", F.lit(0.0)).alias("mean"), F.lit(0.0).alias("m2")
        )
        parts = merge_moments(seen.select(*keys, label, "n", "mean", "m2").unionByName(mass), [*keys, label])
    else:
        parts, medians = seen, None
    g = with_pooled_mean(parts, keys).groupBy(*keys).agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_pooled"), 2)).alias("_between"),
        F.sum("m2").alias("_within"),
        F.sum("n").alias("_n"),
        F.count(F.lit(1)).alias("_k"),
        F.first("_pooled").alias("mean"),
    )
    df1, df2 = F.col("_k") - 1, F.col("_n") - F.col("_k")
    f = F.when((df1 > 0) & (df2 > 0) & (F.col("_within") > 0), (F.col("_between") / df1) / (F.col("_within") / df2))
    sd = F.sqrt((F.col("_between") + F.col("_within")) / F.col("_n"))
    t = g.select(*keys, f.alias("f"), "mean", F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sd"))
    best = select_k_best(t, top, FOLD)
    if medians is None:
        return best.withColumn("fill", F.lit(0.0))
    out = join_on(best, medians.withColumnRenamed("median", "fill"), keys, "left")
    return out.withColumn("fill", F.coalesce("fill", F.lit(0.0)))


def recipe_rows(recipes: DataFrame) -> dict[tuple[int, int], list[dict]]:
    """Recipes by (repeat, fold) on the driver: folds x selected features rows, the numbers of the
    projections that apply them. They grow with the plan of folds, not with the data."""
    rows = recipes.collect()
    out: dict[tuple[int, int], list[dict]] = {}
    for r in sorted((r.asDict() for r in rows), key=lambda r: r["rank"]):
        out.setdefault((r["repeat"], r["fold"]), []).append(r)
    return out


def apply_recipe(df: DataFrame, recipe: Sequence[dict], keep: Sequence[str], array_col: str | None = None, out: str = "features") -> DataFrame:
    """Vector of filled, scaled features in recipe order. Features are positions in
    `array_col`, or column names without it."""

    def cell(r: dict):
        raw = F.col(array_col)[int(r["feature"])] if array_col else F.col(f"`{r['feature']}`")
        raw = raw.cast("double")
        return (F.coalesce(F.when(~F.isnan(raw), raw), F.lit(r["fill"])) - F.lit(r["mean"])) / F.lit(r["sd"])

    return df.select(*keep, array_to_vector(F.array(*[cell(r) for r in recipe])).alias(out))
