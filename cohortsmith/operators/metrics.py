"""Metrics over scores(by..., label, prob): counts, curves, ranks, thresholds, intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest, hash_int
from ..functions.stats import normal_tail, safe_div
from ..session import durable, join_on, task_count
from .ranking import bucket_bounds, hash_rank, running_totals

# ---- counts at a cut ---------------------------------------------------------


def confusion(pred: DataFrame, by: Sequence[str] = (), label: str = "label", predicted: str = "predicted") -> DataFrame:
    """tn, fp, fn, tp per group."""
    y, p = F.col(label), F.col(predicted)

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return pred.groupBy(*by).agg(
        n((y == 0) & (p == 0)).alias("tn"),
        n((y == 0) & (p == 1)).alias("fp"),
        n((y == 1) & (p == 0)).alias("fn"),
        n((y == 1) & (p == 1)).alias("tp"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy, precision, recall, f1; a zero denominator gives 0.

    Balanced accuracy averages the recall of the classes that occur.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    recall, tnr = safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    both = (F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)).cast("double")
    return counts.withColumns(
        {
            "accuracy": safe_div(tp + tn, tn + fp + fn + tp),
            "balanced_accuracy": safe_div(recall + tnr, both),
            "precision": safe_div(tp, tp + fp),
            "recall": recall,
            "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        }
    )


def classification_report(pred: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Per-class precision, recall, f1 and support, then accuracy, macro and weighted averages."""
    cells = pred.groupBy(F.col(label).alias("_y"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # From here on the tables have at most classes x classes rows.
    as_true = cells.select(F.col("_y").alias("_k"), F.col("_n").alias("_t"), F.lit(0).cast("long").alias("_q"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("_h"))
    as_pred = cells.select(F.col("_p").alias("_k"), F.lit(0).cast("long").alias("_t"), F.col("_n").alias("_q"), F.lit(0).cast("long").alias("_h"))
    k = as_true.unionByName(as_pred).groupBy("_k").agg(F.sum("_t").alias("support"), F.sum("_q").alias("_q"), F.sum("_h").alias("_h"))
    per = k.select(
        F.col("_k").cast("string").alias("class"),
        safe_div(F.col("_h"), F.col("_q")).alias("precision"),
        safe_div(F.col("_h"), F.col("support")).alias("recall"),
        safe_div(2 * F.col("_h"), F.col("_q") + F.col("support")).alias("f1"),
        "support",
        F.col("_h"),
    )
    total = F.sum("support")
    acc = safe_div(F.sum("_h"), total)

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / total

    cols = ["class", "precision", "recall", "f1", "support"]
    rows = per.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"), total.alias("support")),
        ).alias("_rows")
    )
    summary = rows.select(F.inline("_rows"))
    return per.select(*cols).unionByName(summary.select(*cols))


# ---- curves ------------------------------------------------------------------


def score_points(
    scores: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    prob: str = "prob",
    bounds: list[float] | None = None,
) -> DataFrame:
    """One row per distinct (group, score), from the highest score down, with

    pos, neg       rows of each class at this score
    run_pos/_neg   rows of each class at or above it (true and false positives of a cut here)
    tot_pos/_neg   rows of each class in the group
    """
    valid = scores.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
    if bounds is None:
        bounds = bucket_bounds(valid, prob)
    cells = valid.groupBy(*by, F.col(prob).cast("double").alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("neg"),
    )
    return running_totals(cells, "score", ["pos", "neg"], by, descending=True, bounds=bounds)


def pr_curve(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """threshold, precision, recall; the closing point has precision 1, recall 0, no threshold."""
    body = points.select(
        *by,
        F.col("score").alias("threshold"),
        safe_div(F.col("run_pos"), F.col("run_pos") + F.col("run_neg")).alias("precision"),
        safe_div(F.col("run_pos"), F.col("tot_pos")).alias("recall"),
    )
    end = points.select(*by).distinct() if by else points.limit(1)
    last = end.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return body.unionByName(last)


def roc_auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null with one class."""
    below = F.col("tot_neg") - F.col("run_neg")
    won = F.col("pos").cast("double") * (below.cast("double") + F.col("neg") / 2.0)
    pairs = F.max("tot_pos").cast("double") * F.max("tot_neg")
    return points.groupBy(*by).agg(F.when(pairs > 0, F.sum(won) / pairs).alias("roc_auc"))


def average_precision(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision, no interpolation; 0 without positives."""
    step = F.col("pos") * (F.col("run_pos") / (F.col("run_pos") + F.col("run_neg")))
    return points.groupBy(*by).agg(safe_div(F.sum(step), F.max("tot_pos")).alias("avg_precision"))


def brier(scores: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(F.pow(F.col(prob) - F.col(label), 2)).alias("brier"))


def rank_sum_test(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """z of the positives' rank sum against the negatives (average ranks, no tie or
    continuity correction) and the one-sided p that positives score higher."""
    n1, n0 = F.max("tot_pos").cast("double"), F.max("tot_neg").cast("double")
    at_or_above = F.col("run_pos") + F.col("run_neg")
    n = F.col("tot_pos") + F.col("tot_neg")
    here = F.col("pos") + F.col("neg")
    avg_rank = (n - at_or_above).cast("double") + (here + 1) / 2.0
    w = F.sum(F.col("pos") * avg_rank)
    z = (w - n1 * (n1 + n0 + 1) / 2.0) / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0)
    d = points.groupBy(*by).agg(F.when((n1 > 0) & (n0 > 0), z).alias("z"))
    return d.withColumn("p_greater", normal_tail(F.col("z")))


def prob_distribution(scores: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    """Mean and population deviation of the score per class."""
    return scores.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(prob).alias("prob_mean"),
        F.stddev_pop(prob).alias("prob_std"),
    )


def positive_probs(scores: DataFrame, id_col: str, by: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    """The positives' scores, one row each, best first within a group: the list form of
    this would hold a whole class in one cell."""
    return scores.filter(F.col(label) == 1).select(*by, id_col, prob)


# ---- thresholds --------------------------------------------------------------


def _at_cut(points: DataFrame) -> DataFrame:
    d = points.withColumns(
        {
            "tp": F.col("run_pos"),
            "fp": F.col("run_neg"),
            "fn": F.col("tot_pos") - F.col("run_pos"),
            "tn": F.col("tot_neg") - F.col("run_neg"),
        }
    )
    return with_rates(d)


def threshold_max_f1(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The distinct score with the best F1, ties to the lowest. Scores are clipped to
    [0, 1] first, so pass points of clipped scores when they may lie outside."""
    cut = _at_cut(points)
    best = F.max_by(
        F.struct("score", "f1"), F.struct(F.col("f1"), (-F.col("score")).alias("_low"))
    ).alias("_b")
    g = cut.groupBy(*by).agg(best)
    return g.select(*by, F.col("_b.score").alias("threshold"), F.col("_b.f1").alias("f1"))


def threshold_recall_at_precision(points: DataFrame, min_precision: float = 0.20, by: Sequence[str] = ()) -> DataFrame:
    """Best recall among cuts with precision >= min_precision, ties to the lowest cut.
    The curve's end point (threshold 1, recall 0) always qualifies."""
    cut = _at_cut(points)
    ok = cut.filter(F.col("precision") >= min_precision).select(*by, "score", "recall")
    end = cut.groupBy(*by).agg(F.lit(1.0).alias("score"), F.lit(0.0).alias("recall"))
    best = F.max_by(F.col("score"), F.struct(F.col("recall"), (-F.col("score")).alias("_low"))).alias("threshold")
    return ok.unionByName(end).groupBy(*by).agg(best)


def apply_threshold(
    scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = (), prob: str = "prob", out: str = "predicted"
) -> DataFrame:
    """predicted = score >= threshold of the row's group. Groups without a threshold use 0.5."""
    if by:
        j = join_on(scores, thresholds.select(*by, "threshold"), list(by), "left")
    else:
        row = thresholds.select("threshold").first()
        j = scores.withColumn("threshold", F.lit(float(row[0]) if row else 0.5))
    cut = F.coalesce(F.col("threshold"), F.lit(0.5))
    return j.withColumn(out, (F.col(prob) >= cut).cast("int")).drop("threshold")


def clip_unit(scores: DataFrame, prob: str = "prob") -> DataFrame:
    return scores.withColumn(prob, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(prob))))


def score_minmax(scores: DataFrame, by: Sequence[str] = (), score: str = "score", out: str = "prob") -> DataFrame:
    """Decision scores scaled to [0, 1) by the range of their group."""
    keys = list(by) or ["_all"]
    d = scores if by else scores.withColumn("_all", F.lit(0))
    lim = d.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    j = join_on(d, lim, keys)
    scaled = (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-12))
    return j.withColumn(out, scaled).drop("_lo", "_hi", "_all")


# ---- intervals ---------------------------------------------------------------


def bootstrap_ci(
    values: DataFrame, id_col: str, value: str, by: Sequence[str] = (), draws: int = 2_000, seed: int = 42
) -> DataFrame:
    """2.5 and 97.5 percentiles of the mean over `draws` resamples with replacement.

    Each value is numbered in its group; draw b takes slot s's value number
    h(seed:b:s) mod n. The draws of a group meet its values in an equi join and are
    averaged map-side.
    """
    keys = list(by) or ["_all"]
    d = values.filter(F.col(value).isNotNull())
    d = d if by else d.withColumn("_all", F.lit(0))
    numbered = durable(hash_rank(d.select(*keys, id_col, value), id_col, seed, by=keys, out="_i"))
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slots = join_on(numbered.select(*keys, F.col("_i").alias("_slot")), sizes, keys)
    # explode makes the draws next to the slot they belong to; nothing is cross joined.
    # Blocks of draws are spread over the cluster before they unfold.
    block = 100
    slots = slots.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block))))
    slots = slots.repartition(task_count(values.sparkSession))
    first = F.col("_blk") * block
    last = F.least(first + block, F.lit(draws)) - 1
    drawn = slots.withColumn("_b", F.explode(F.sequence(first, last))).drop("_blk")
    drawn = drawn.withColumn("_i", hash_int(seed, F.col("_b"), F.col("_slot")) % F.col("_n") + 1)
    got = join_on(drawn, numbered.select(*keys, "_i", value), [*keys, "_i"])
    means = got.groupBy(*keys, "_b").agg(F.avg(value).alias("_m"))
    ci = means.groupBy(*keys).agg(
        F.avg("_m").alias("boot_mean"),
        F.percentile("_m", F.lit(0.025)).alias("ci_low"),
        F.percentile("_m", F.lit(0.975)).alias("ci_high"),
    )
    return ci if by else ci.drop("_all")


#: Poisson(1): 2^32 times the probability of at most k, for k from 0; beyond the last a weight of 13 stands for the rest.
POISSON_STEPS = tuple(int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(13))
#: Draws that one digest serves, eight hex digits each.
DRAWS_A_DIGEST = 4


def poisson_bootstrap_ci(
    values: DataFrame, id_col: str, value: str, by: Sequence[str] = (), draws: int = 2_000, seed: int = 42
) -> DataFrame:
    """2.5 and 97.5 percentiles of the mean over `draws` resamples, for any number of rows.

    In each draw a row has a Poisson(1) weight from the digest of seed, row and draw, which is how
    often a resample of as many rows would take it, but for the total. Weights need no numbering and
    no join: a task sums weight times value of its rows for every draw, and only those sums are
    shuffled. Rows must have ids of their own; rows with equal ids are drawn together. A draw that
    takes no row of a group does not count for it.
    """
    keys = list(by) or ["_all"]
    d = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    d = d if by else d.withColumn("_all", F.lit(0))
    blocks = -(-draws // DRAWS_A_DIGEST)
    rows = d.select(*keys, F.col(value).cast("double").alias("_v"), F.col(id_col).alias("_id"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_blk"))
    rows = rows.withColumn("_h", digest(seed, F.col("_id"), F.col("_blk")))
    sums = []
    for i in range(DRAWS_A_DIGEST):
        u = F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long")
        weight = reduce(lambda a, b: a + b, [(u >= t).cast("int") for t in POISSON_STEPS])
        sums += [F.sum(weight * F.col("_v")).alias(f"_s{i}"), F.sum(weight).alias(f"_w{i}")]
    parts = rows.groupBy(*keys, "_blk").agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_s{i}").alias("s"), F.col(f"_w{i}").alias("w")) for i in range(DRAWS_A_DIGEST)]))
    drawn = parts.select(*keys, "_blk", each.alias("_x")).filter((F.col("_blk") * DRAWS_A_DIGEST + F.col("_x.i") < draws) & (F.col("_x.w") > 0))
    mean = F.col("_x.s") / F.col("_x.w")
    ci = drawn.groupBy(*keys).agg(
        F.avg(mean).alias("boot_mean"), F.percentile(mean, F.lit(0.025)).alias("ci_low"), F.percentile(mean, F.lit(0.975)).alias("ci_high")
    )
    return ci if by else ci.drop("_all")
