"""Parameter candidates, random search and out-of-fold scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from hashlib import md5
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from . import metrics as M
from .models import fit_balanced_bags, fit_gbt, fit_logistic, fit_random_forest, run_parallel, score, with_unit_weight
from .weights import cost_weights, weigh_for_fit

# Candidate lists per model.
KBEST_CANDIDATES = (20, 30, 50, 75, 100)
KBEST_FALLBACK = 20
L1_CANDIDATES = (0.02, 0.05, 0.1, 0.2, 0.5)
GRIDS = {
    "RandomForest": {"trees": (100, 200, 400), "depth": (3, 5, None), "min_leaf": (1, 2, 4)},
    "GradientBoosting": {"rounds": (100, 200, 400), "rate": (0.03, 0.05, 0.1), "depth": (2, 3)},
    "LogisticRegression": {"c": (0.1, 0.2, 0.5, 1.0, 2.0)},
    "BalancedRF": {"trees": (100, 200, 400), "depth": (3, 5, None)},
}
# Models whose selector has an L1 stage to tune.
L1_SELECTED = ("RandomForest", "BalancedRF")


def param_grid(model: str, n_features: int) -> dict[str, tuple]:
    """Named candidate lists for a model on a table of this width."""
    ks = tuple(k for k in KBEST_CANDIDATES if k <= n_features) or (min(KBEST_FALLBACK, n_features),)
    grid: dict[str, tuple] = {"k": ks}
    if model in L1_SELECTED:
        grid["l1_c"] = L1_CANDIDATES
    return {**grid, **GRIDS[model]}


def search_lists(name: str, model: str, n_features: int) -> dict[str, tuple]:
    """Candidate lists of three further searches, with the neighbour count of a resampler.
    A training set that has fewer rare rows caps smote_k where it is used."""
    p = n_features
    # Fixed values.
    lists = {
        "robust": {"smote_k": (1, 2, 3), "k": (50, 100, 200), "l1_c": (0.02, 0.05, 0.1, 0.2)},
        "resampling": {"smote_k": (1, 2, 3), "k": (50, 100, min(200, max(50, p // 10)))},
        "focused": {"smote_k": (1, 2), "k": (100, 200, min(500, max(100, p // 10))), "l1_c": (0.1, 0.5, 1.0)},
    }
    trees = {
        "robust": {"RandomForest": {"trees": (100, 200), "depth": (3, 5, None)}, "GradientBoosting": {"rounds": (100, 200), "depth": (3, 5)}},
        "resampling": {"BalancedRF": {"trees": (100, 200)}, "BalancedBagging": {"trees": (100, 200)}},
        "focused": {"BalancedRF": {"trees": (100, 200)}},
    }
    return {**lists[name], **trees[name].get(model, {})}


def grid_table(spark: SparkSession, grid: dict[str, Sequence]) -> DataFrame:
    """All combinations as rows of (candidate, params)."""
    names = sorted(grid)
    rows = [(i, {n: str(v) for n, v in zip(names, c)}) for i, c in enumerate(product(*[grid[n] for n in names]))]
    return spark.createDataFrame(rows, "candidate int, params map<string,string>")


def sample_params(grid: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n different combinations, in md5 order of their number."""
    names = sorted(grid)
    combos = list(product(*[grid[n] for n in names]))
    order = sorted(range(len(combos)), key=lambda i: md5(f"{seed}:{i}".encode()).hexdigest())
    return [dict(zip(names, combos[i])) for i in order[: min(n, len(combos))]]


def model_grid(spark: SparkSession, resamplers: Sequence[str], models: Sequence[str], pca: Sequence[int | None] = (None,)) -> DataFrame:
    """Every resampler x model x PCA size as a configuration row."""
    rows = [(f"{r}__{m}", r, m, p) for r, m, p in product(resamplers, models, pca)]
    return spark.createDataFrame(rows, "combo string, resampler string, model string, pre_pca int")


def fit_named(model: str, train: DataFrame, params: dict, id_col: str, seed: int = 42, parallelism: int = 4):
    """Fit by name. `weights` is 'balanced' (the rule for forests and logistic models), None
    (the rule for boosting) or the cost of a positive row; balanced bags need none."""
    own = {k: v for k, v in params.items() if k not in ("k", "l1_c", "smote_k")}
    weights = own.pop("weights", None if model == "GradientBoosting" else "balanced")
    if model not in ("BalancedRF", "BalancedBagging") and weights is not None:
        train = weigh_for_fit(train)[0] if weights == "balanced" else cost_weights(train, weights)
    if model == "RandomForest":
        return fit_random_forest(train, seed=seed, **own)
    if model == "LogisticRegression":
        return fit_logistic(with_unit_weight(train), **own)
    if model == "GradientBoosting":
        return fit_gbt(train, seed=seed, **own)
    if model == "BalancedRF":
        return fit_balanced_bags(train, id_col, seed=seed, parallelism=parallelism, **own)
    if model == "BalancedBagging":
        return fit_balanced_bags(train, id_col, all_features=True, seed=seed, parallelism=parallelism, **own)
    raise ValueError(f"unknown model {model!r}")


def fill_uninformative(scores: DataFrame, prob: str = "prob") -> DataFrame:
    """A row whose fold gave no model scores 0.5 and is marked."""
    d = scores.withColumn("failed", F.col(prob).isNull() | F.isnan(prob))
    return d.withColumn(prob, F.when(F.col("failed"), F.lit(0.5)).otherwise(F.col(prob)))


def count_failed(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(F.count(F.when(F.col("failed"), 1)).alias("n_failed"), F.count(F.lit(1)).alias("n"))


@dataclass
class FoldScores:
    """Out-of-fold scores and, per fold, the error text of a fit that failed."""

    scores: DataFrame
    errors: dict = field(default_factory=dict)


def out_of_fold(
    rows: DataFrame,
    fit: Callable[[DataFrame], object],
    keep: Sequence[str],
    folds: Sequence[tuple[int, int]],
    prepare: Callable[[DataFrame, int, int], DataFrame] | None = None,
    parallelism: int = 4,
    fallback: Callable[[DataFrame], object] | None = None,
    must_fit: bool = False,
) -> FoldScores:
    """Score every row with the model of the other folds.

    rows: repeat, fold, keep..., label, features (or whatever prepare turns into them).
    A failed fit falls back when a fallback is given; failing that too, its rows score
    0.5 and the error is kept, not swallowed. With `must_fit` a fold without a model raises
    instead: whoever does not hand on `failed` would show those rows as scores of a model.
    """
    prepare = prepare or (lambda d, r, f: d)
    errors: dict = {}

    def job(r: int, f: int) -> DataFrame:
        here = prepare(rows.filter(F.col("repeat") == r), r, f)
        train, test = here.filter(F.col("fold") != f), here.filter(F.col("fold") == f)
        model = cause = None
        for attempt in [fit, fallback]:
            if attempt is None:
                continue
            try:
                model = attempt(train)
                break
            except Exception as e:  # recorded for the caller
                errors[(r, f)], cause = str(e), e
        if model is None and must_fit:
            raise RuntimeError(f"no model of repeat {r}, fold {f}: {cause}") from cause
        if model is None:
            return test.select(*keep, F.lit(None).cast("double").alias("prob"))
        return score(model, test, keep)

    parts = run_parallel([lambda r=r, f=f: job(r, f) for r, f in folds], parallelism)
    # Curves read the scores more than once; the models should run only once.
    return FoldScores(durable(fill_uninformative(reduce(DataFrame.unionByName, parts))), errors)


def fold_auc(scores: DataFrame, by: Sequence[str] = ("repeat", "fold")) -> DataFrame:
    by = list(by)
    return M.roc_auc(M.score_points(scores, by), by)


def cross_val_summary(auc: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold AUCs."""
    return auc.agg(F.count("roc_auc").alias("folds"), F.avg("roc_auc").alias("auc_mean"), F.stddev_pop("roc_auc").alias("auc_std"))


def pick_best(table: list[tuple[int, float | None]]) -> int:
    """The candidate with the highest mean score; the first one on ties."""
    usable = [(s, -i) for i, s in table if s is not None]
    return -max(usable)[1] if usable else table[0][0]


def inner_score(scores: DataFrame, scorer: str = "roc_auc", of: Sequence[str] = ()) -> DataFrame:
    """Mean score per candidate (and `of`) over the inner folds, by AUC or by F1 of class 1 at 0.5."""
    by = [*of, "candidate", "fold"]
    if scorer == "roc_auc":
        per = fold_auc(scores, by).withColumnRenamed("roc_auc", "s")
    elif scorer == "f1":
        pred = scores.withColumn("predicted", (F.col("prob") >= 0.5).cast("int"))
        per = M.with_rates(M.confusion(pred, by)).select(*by, F.col("f1").alias("s"))
    else:
        raise ValueError("scorer must be 'roc_auc' or 'f1'")
    return per.groupBy(*of, "candidate").agg(F.avg("s").alias("score"))
