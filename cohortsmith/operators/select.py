"""Univariate feature selection on the long form, whole table or every fold at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k
from .scale import moments, with_pooled_mean


def f_from_moments(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-way F per feature from per-class (n, mean, m2). Null where F is undefined:
    a constant feature, a single class or no spare degree of freedom."""
    keys = [*by, "feature"]
    g = with_pooled_mean(parts, keys).groupBy(*keys).agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_pooled"), 2)).alias("_between"),
        F.sum("m2").alias("_within"),
        F.sum("n").alias("_n"),
        F.count(F.lit(1)).alias("_k"),
    )
    df1, df2 = F.col("_k") - 1, F.col("_n") - F.col("_k")
    f = F.when(
        (df1 > 0) & (df2 > 0) & (F.col("_within") > 0), (F.col("_between") / df1) / (F.col("_within") / df2)
    )
    return g.select(*keys, f.alias("f"))


def anova_f(long: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """F of each feature against the label: one aggregation over the rows."""
    parts = moments(long.filter(F.col(label).isNotNull()), [*by, "feature", label])
    return f_from_moments(parts, by)


def select_k_best(scores: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k highest F; undefined F ranks last, equal F goes to the later feature."""
    return top_k(scores, k, [F.col("f").desc_nulls_last(), F.col("feature").desc()], by)


def k_rule(p: int, low: int = 5, fallback: int = 20, high: int = 100) -> int:
    """Default number of features for a width of p."""
    return max(low, min(max(fallback, p // 20), high, p))


# How many features the studies keep of a width of p, by name of the rule.
K_RULES: dict[str, Callable[[int], int]] = {
    "default": k_rule,
    "at_most_50": lambda p: min(50, p),
    "at_most_200": lambda p: min(200, p),
    "tenth": lambda p: max(1, p // 10),
    "fifth": lambda p: max(1, p // 5),
}
# And how many where an L1 stage keeps none.
FALLBACK_RULES: dict[str, Callable[[int], int]] = {
    "at_most_25": lambda p: min(25, p),
    "tenth_at_most_50": lambda p: max(1, min(50, p // 10)),
    "tenth_at_most_100": lambda p: max(1, min(100, p // 10)),
    "all": lambda p: p,
}


def by_rules(scores: DataFrame, p: int, rules: Sequence[str] = tuple(K_RULES)) -> DataFrame:
    """rule, feature, f, rank: what each rule keeps of scores of p features, from one ranking."""
    sizes = {r: K_RULES[r](p) for r in rules}
    ranked = select_k_best(scores, max(sizes.values()))
    kept = F.array(*[F.when(F.col("rank") <= k, F.lit(r)) for r, k in sizes.items()])
    return ranked.select(F.explode(F.array_compact(kept)).alias("rule"), "feature", "f", "rank")


def double_k_best(scores: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Two F filters in a row, the second with max(10, k // 5)."""
    first = select_k_best(scores, k, by).drop("rank")
    return select_k_best(first, max(10, k // 5), by)
