"""Hold-out splits and fold plans from md5 order: balanced, repeatable, checkable.

Functions named assign_* keep every column of the row, so features travel through the
one shuffle that ranks them and need no join afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import join_on
from .ranking import hash_rank


def assign_holdout(
    df: DataFrame,
    id_col: str,
    label: str = "label",
    test_size: float = 0.2,
    seed: int = 42,
    stratify: str = "always",
) -> DataFrame:
    """Adds role 'train' or 'test'.

    The test set has ceil(test_size * n) rows, shared among the classes in proportion
    (largest remainder, ties to the lower label). With stratify='auto' the classes are
    ignored when one of them has a single row.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    every = W.partitionBy(F.lit(1))
    stats = counts.select(
        label,
        "_c",
        F.sum("_c").over(every).alias("_n"),
        F.min("_c").over(every).alias("_least"),
    )
    pooled = (F.col("_least") < 2) if stratify == "auto" else F.lit(False)
    stats = stats.withColumn("_pooled", pooled).withColumn(
        "_target", F.ceil(F.lit(float(test_size)) * F.col("_n") - F.lit(1e-9))
    )
    exact = F.col("_target") * F.col("_c") / F.col("_n")
    stats = stats.withColumn("_base", F.floor(exact)).withColumn("_frac", F.round(exact - F.floor(exact), 9))
    left = F.col("_target") - F.sum("_base").over(every)
    by_frac = W.partitionBy(F.lit(1)).orderBy(F.col("_frac").desc(), F.col(label).asc())
    stats = stats.withColumn("_left", left).withColumn("_pos", F.row_number().over(by_frac))
    stats = stats.withColumn("_quota", F.col("_base") + (F.col("_pos") <= F.col("_left")).cast("long"))
    tagged = join_on(df, stats.select(label, "_quota", "_target", "_pooled"), [label])
    tagged = tagged.withColumn("_stratum", F.when(F.col("_pooled"), F.lit(None)).otherwise(F.col(label)))
    ranked = hash_rank(tagged, id_col, seed, by=["_stratum"], out="_rank")
    cut = F.when(F.col("_pooled"), F.col("_target")).otherwise(F.col("_quota"))
    role = F.when(F.col("_rank") <= cut, F.lit("test")).otherwise(F.lit("train"))
    return ranked.withColumn("role", role).drop("_quota", "_target", "_pooled", "_stratum", "_rank")


def assign_folds(
    df: DataFrame,
    id_col: str,
    label: str = "label",
    k: int = 5,
    repeats: int = 1,
    seed: int = 42,
    by: Sequence[str] = (),
) -> DataFrame:
    """Adds repeat and the row's test fold.

    Rows are ranked in (label, hash) order and dealt out in turn, so every class and
    every fold is level to within one row. Each repeat shuffles with its own seed.

    With several repeats the plan is made from ids and labels alone and joined back as
    one short list per row, so wide rows are shuffled once and not once per repeat.
    """
    narrow = list(dict.fromkeys([id_col, label, *by]))
    if repeats > 1 and set(df.columns) - set(narrow):
        plan = assign_folds(df.select(*narrow), id_col, label, k, repeats, seed, by)
        lists = plan.groupBy(*dict.fromkeys([id_col, *by])).agg(F.collect_list(F.struct("repeat", "fold")).alias("_plan"))
        joined = join_on(df, lists, list(dict.fromkeys([id_col, *by])))
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.inline("_plan"))
    rep = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = hash_rank(
        rep,
        id_col,
        F.concat_ws("-", F.lit(str(seed)), F.col("repeat").cast("string"), *[F.col(c).cast("string") for c in by]),
        by=["repeat", *by],
        then=[label],
        out="_rank",
    )
    fold = ((F.col("_rank") - 1) % k).cast("int")
    return ranked.withColumn("fold", fold).drop("_rank")


def fold_plan(df: DataFrame, id_col: str, label: str = "label", k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """The plan alone: id, label, repeat, fold."""
    return assign_folds(df.select(id_col, label), id_col, label, k, repeats, seed)


def inner_folds(plan: DataFrame, id_col: str, k_outer: int, k_inner: int, label: str = "label", seed: int = 42) -> DataFrame:
    """Folds inside each outer training set: id, label, repeat, fold, inner_fold."""
    folds = F.array(*[F.lit(i) for i in range(k_outer)])
    train = plan.select(
        id_col,
        label,
        F.col("repeat").alias("outer_repeat"),
        F.explode(F.array_except(folds, F.array("fold"))).alias("outer_fold"),
    )
    inner = assign_folds(train, id_col, label, k_inner, 1, seed, by=["outer_repeat", "outer_fold"])
    return inner.select(
        id_col,
        label,
        F.col("outer_repeat").alias("repeat"),
        F.col("outer_fold").alias("fold"),
        F.col("fold").alias("inner_fold"),
    )


def leave_one_out(df: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """Plan in which every row is its own test fold."""
    return df.select(F.col(id_col), F.col(label), F.lit(0).alias("repeat"), F.col(id_col).alias("fold"))


def loo_centroid_scores(long: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """Leave-one-out nearest-centroid score without refitting.

    Class sums are taken once; a row's own values are subtracted from its class before
    its squared distance to both centroids is measured. score = d(neg) - d(pos).
    A class that has no other row has no centroid, and the row scores 0.
    """
    # Both classes side by side: one row per feature, so the join has one small side.
    pos, neg = F.col(label) == 1, F.col(label) == 0
    sums = long.groupBy("feature").agg(
        F.count(F.when(pos, F.col("value"))).alias("_n1"),
        F.coalesce(F.sum(F.when(pos, F.col("value"))), F.lit(0.0)).alias("_s1"),
        F.count(F.when(neg, F.col("value"))).alias("_n0"),
        F.coalesce(F.sum(F.when(neg, F.col("value"))), F.lit(0.0)).alias("_s0"),
    )
    j = join_on(long, sums, ["feature"])

    def gap(own, n: str, s: str):
        own_i = own.cast("int")
        left = F.col(n) - own_i
        c = (F.col(s) - F.col("value") * own_i) / F.nullif(left, F.lit(0))
        return F.pow(F.col("value") - c, 2)

    d1, d0 = gap(pos, "_n1", "_s1"), gap(neg, "_n0", "_s0")
    return j.groupBy(id_col, label).agg(F.coalesce(F.sum(d0) - F.sum(d1), F.lit(0.0)).alias("score"))


def fold_audit(plan: DataFrame, label: str = "label") -> DataFrame:
    """Train and test sizes and the minority rows left for training, per (repeat, fold).

    Training counts are totals minus test counts over the table of fold counts. The
    minority is the rarer class of the repeat, ties to 1.
    """
    pos = F.count(F.when(F.col(label) == 1, 1))
    test = plan.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("test_size"), pos.alias("_p"))
    w = W.partitionBy("repeat")
    n, p = F.sum("test_size").over(w), F.sum("_p").over(w)
    d = test.select("*", n.alias("_n"), p.alias("_tp"))
    train_pos = F.col("_tp") - F.col("_p")
    train = F.col("_n") - F.col("test_size")
    return d.select(
        "repeat",
        "fold",
        train.alias("train_size"),
        "test_size",
        F.col("_p").alias("test_pos"),
        F.when(F.col("_tp") <= F.col("_n") - F.col("_tp"), train_pos).otherwise(train - train_pos).alias("n_minority_train"),
    )


def fold_validity(plan: DataFrame, label: str = "label") -> DataFrame:
    """Marks folds whose test rows are all of one class."""
    return plan.groupBy("repeat", "fold").agg(
        F.when(F.min(label) == F.max(label), F.lit("no_positives_in_test")).otherwise(F.lit("ok")).alias("note")
    )
