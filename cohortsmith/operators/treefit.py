"""Many tree models of a search over a small table, each grown whole in one task.

A search grows thousands of forests and boosted trees on a few folds of the same rows. Where the table
fits a task (HELD cells), it travels to the tasks once and every fit is a task's own: no Spark job for
each level of each tree. Larger tables keep Spark ML's distributed fits (operators.models); the
contracts are the same: 32 quantile bins, Gini with class weights, a sqrt-sized choice of features a
node and Poisson bootstrap (forest), equal draws of both classes a tree (balanced forest), regression
trees on the gradient of the log loss (boosting).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, task_count
from .multifit import Recipe, _prepared

# Tasks receive these functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of a table that travels to the tasks whole: 64 MB.
HELD = 1 << 23
#: Bins of a feature, Spark ML's number, and the deepest tree, which stands for "no limit".
BINS, DEEPEST = 32, 30
#: Row entries of a forest that grow at once.
ENTRIES = 1 << 19
#: Parameters that each model takes, with the defaults of operators.models.
DEFAULTS = {
    "RandomForest": {"trees": 200, "depth": 5, "min_leaf": 2},
    "GradientBoosting": {"rounds": 100, "rate": 0.05, "depth": 2},
    "BalancedRF": {"trees": 100, "depth": 5},
}


@dataclass(frozen=True)
class TreeFit:
    """One model: trained on the rows of a view whose inner fold is not `held` (-1: all of them)."""

    view: int
    held: int
    recipe: Recipe
    params: tuple[tuple[str, object], ...]


def binned(x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Bin of every cell, between quantiles of the training rows' distinct values."""
    out = np.empty(x.shape, dtype="int64")
    for j in range(x.shape[1]):
        values = np.unique(x[seen, j])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[seen, j], np.arange(1, BINS) / BINS, method="lower"))
        else:
            values = values[:-1]
        out[:, j] = np.searchsorted(values, x[:, j], "left")
    return out


def _best_cut(least: np.ndarray, score: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Choice of feature and last bin on the left for each node, and whether any cut gains. `least` says
    where a cut is allowed, `score` what both sides are worth and `whole` what the node is."""
    flat = np.where(least, score, -np.inf).reshape(len(score), -1)
    at = flat.argmax(axis=1)
    gains = flat[np.arange(len(flat)), at] > whole + 1e-12 * (1 + np.abs(whole))
    return *np.unravel_index(at, score.shape[1:]), gains


def forest_scores(
    bins: np.ndarray, y: np.ndarray, counts: np.ndarray, weights: tuple[float, float], depth: int, min_leaf: int, rng: np.random.Generator
) -> np.ndarray:
    """Sum over trees of the share of class 1 in each row's leaf. counts: trees x rows, how often a tree
    drew a row (0: not trained on it); all trees grow level by level together."""
    trees, n = counts.shape
    p = bins.shape[1]
    m = int(np.ceil(np.sqrt(p)))
    w = np.where(y == 1, weights[1], weights[0])
    # Every row walks down every tree: entries are (tree, row), trained on or only scored.
    tree, row = (a.ravel() for a in np.indices((trees, n)))
    drawn = counts.ravel().astype("float64")
    node = tree.copy()
    total = np.zeros(n)
    for level in range(depth + 1):
        if not len(row):
            break
        _, node = np.unique(node, return_inverse=True)
        nodes = int(node.max()) + 1
        heavy = drawn * w[row]
        one, every = np.bincount(node, heavy * y[row], nodes), np.bincount(node, heavy, nodes)
        size = np.bincount(node, drawn, nodes)
        value = one / np.maximum(every, 1e-300)
        split = (one > 0) & (one < every) & (size >= 2 * min_leaf) if level < depth else np.zeros(nodes, bool)
        if split.any():
            chosen = np.argsort(rng.random((nodes, p)), axis=1)[:, :m]
            trained = np.flatnonzero((drawn > 0) & split[node])
            e = node[trained]
            cell = ((e[:, None] * m + np.arange(m)) * BINS + bins[row[trained][:, None], chosen[e]]).ravel()
            shape = (nodes, m, BINS)

            def sums(v: np.ndarray) -> np.ndarray:
                return np.bincount(cell, np.repeat(v, m), nodes * m * BINS).reshape(shape).cumsum(axis=2)

            l1, la, lc = sums((heavy * y[row])[trained]), sums(heavy[trained]), sums(drawn[trained])
            r1, ra, rc = l1[:, :, -1:] - l1, la[:, :, -1:] - la, lc[:, :, -1:] - lc
            with np.errstate(divide="ignore", invalid="ignore"):
                worth = (l1**2 + (la - l1) ** 2) / la + (r1**2 + (ra - r1) ** 2) / ra
                own = (one**2 + (every - one) ** 2) / every
            allowed = (lc >= min_leaf) & (rc >= min_leaf) & (la > 0) & (ra > 0)
            nth, cut, gains = _best_cut(allowed, worth, np.where(split, own, 0.0))
            split &= gains
        done = ~split[node]
        total += np.bincount(row[done], value[node[done]], n)
        row, drawn, node = row[~done], drawn[~done], node[~done]
        if len(row):
            node = 2 * node + (bins[row, chosen[node, nth[node]]] > cut[node])
    return total


def boosted_margin(bins: np.ndarray, y: np.ndarray, seen: np.ndarray, rounds: int, rate: float, depth: int) -> np.ndarray:
    """Margins after all rounds: the first tree learns the signs of the classes, each later one, at
    `rate`, the gradient of log(1 + exp(-2 margin)). The margins of all rows are kept."""
    n, p = bins.shape
    cells = np.arange(p) * BINS + bins
    sign = np.where(y == 1, 1.0, -1.0)
    train = np.flatnonzero(seen)
    margin = np.zeros(n)
    for r in range(rounds):
        target = sign if r == 0 else 4 * sign / (1 + np.exp(np.clip(2 * sign * margin, -500, 500)))
        node = np.zeros(n, dtype="int64")
        nodes = 1
        for _ in range(depth):
            at = node[train]
            cell = (at[:, None] * (p * BINS) + cells[train]).ravel()
            left = np.bincount(cell, np.repeat(target[train], p), nodes * p * BINS).reshape(nodes, p, BINS).cumsum(axis=2)
            size = np.bincount(cell, minlength=nodes * p * BINS).reshape(nodes, p, BINS).cumsum(axis=2)
            right, rest = left[:, :, -1:] - left, size[:, :, -1:] - size
            with np.errstate(divide="ignore", invalid="ignore"):
                worth = left**2 / size + right**2 / rest
                own = np.nan_to_num(left[:, 0, -1] ** 2 / size[:, 0, -1])
            feature, cut, gains = _best_cut((size > 0) & (rest > 0), worth, own)
            if not gains.any():
                break
            node = 2 * node + (gains[node] & (bins[np.arange(n), feature[node]] > cut[node]))
            nodes *= 2
        total, size = np.bincount(node[train], target[train], nodes), np.bincount(node[train], minlength=nodes)
        margin += (1.0 if r == 0 else rate) * (total / np.maximum(size, 1))[node]
    return margin


def _checked(model: str, params: dict) -> dict:
    p = {**DEFAULTS[model], **params}
    if unknown := set(p) - set(DEFAULTS[model]):
        raise ValueError(f"{model} does not take {sorted(unknown)}")
    p["depth"] = DEEPEST if p["depth"] is None else p["depth"]
    if not 0 <= p["depth"] <= DEEPEST or min(p.get("trees", 1), p.get("rounds", 1), p.get("min_leaf", 1)) < 1 or not 0 < p.get("rate", 1) <= 1:
        raise ValueError(f"parameters out of range: {params}")
    return p


def probabilities(model: str, x: np.ndarray, y: np.ndarray, seen: np.ndarray, params: dict, seed: int) -> np.ndarray:
    """Probability of class 1 of every row by the model grown on the rows `seen`."""
    p = _checked(model, params)
    classes = [np.flatnonzero(seen & (y == c)) for c in (0, 1)]
    if not all(len(c) for c in classes):
        raise ValueError("the training rows have one class")
    bins = binned(x, seen)
    if model == "GradientBoosting":
        return 1 / (1 + np.exp(np.clip(-2 * boosted_margin(bins, y, seen, p["rounds"], p["rate"], p["depth"]), -500, 500)))
    rng = np.random.default_rng(seed)
    size = np.array([len(c) for c in classes])
    weights = tuple(size.sum() / (2 * size)) if model == "RandomForest" else (1.0, 1.0)
    total, step = np.zeros(len(y)), max(1, ENTRIES // len(y))
    for lo in range(0, p["trees"], step):
        trees = min(step, p["trees"] - lo)
        if model == "RandomForest":
            counts = rng.poisson(1.0, (trees, len(y))) * seen
        else:
            counts = np.zeros((trees, len(y)), dtype="int64")
            for c in classes:
                np.add.at(counts, (np.arange(trees)[:, None], c[rng.integers(0, len(c), (trees, size.min()))]), 1)
        total += forest_scores(bins, y, counts, weights, p["depth"], p.get("min_leaf", 1), rng)
    return total / p["trees"]


def fits_a_task(rows: DataFrame, width: int) -> bool:
    return rows.count() * width <= HELD


def score_trees(rows: DataFrame, model: str, fits: Sequence[TreeFit], id_col: str, trained: bool = False, seed: int = 42) -> tuple[DataFrame, dict[int, str]]:
    """As multifit.score_many: id, label, fit, role, prob of the rows that each model left out, with
    `trained` also of those it saw; and the errors of fits that failed."""
    spark = rows.sparkSession
    # At most HELD cells, in an order of their own.
    table = rows.select(id_col, "label", "x", "views").orderBy(id_col, F.to_json(F.struct("x"))).toPandas()
    x = np.array(table["x"].tolist(), dtype="float64").reshape(len(table), -1)
    views = np.array(table["views"].tolist(), dtype="int64").reshape(len(table), -1)
    fits = list(fits)  # by value with the function; a broadcast holds plain arrays
    held = spark.sparkContext.broadcast((x, views, table["label"].to_numpy().astype("int64")))
    schema = T.StructType(
        [T.StructField("at", T.LongType()), *(T.StructField(c, t) for c, t in (("fit", T.IntegerType()), ("role", T.StringType()), ("prob", T.DoubleType()), ("error", T.StringType())))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, views, y = held.value
        for b in batches:
            for i in b["fit"].tolist():
                fit = fits[i]
                fold = views[:, fit.view]
                seen = (fold != -1) & (fold != fit.held)
                test = fold == fit.held
                try:
                    prob = probabilities(model, _prepared(x, fit.recipe)[:, :-1], y, seen, dict(fit.params), seed)
                except Exception as e:  # handed to the caller
                    yield pd.DataFrame({"at": [-1], "fit": [i], "role": ["error"], "prob": [np.nan], "error": [str(e)]})
                    continue
                shown = np.flatnonzero(seen | test if trained else test)
                yield pd.DataFrame({"at": shown, "fit": i, "role": np.where(test[shown], "test", "train"), "prob": prob[shown], "error": None})

    jobs = spark.createDataFrame([(i,) for i in range(len(fits))], "fit int").repartition(4 * task_count(spark))
    done = durable(jobs.mapInPandas(run, schema))
    held.unpersist()
    errors = {r["fit"]: r["error"] for r in done.filter("role = 'error'").select("fit", "error").collect()}
    names = spark.createDataFrame(table[[id_col, "label"]].assign(at=np.arange(len(table))), T.StructType([rows.schema[id_col], rows.schema["label"], schema["at"]]))
    return done.filter("role <> 'error'").join(durable(names), "at").select(id_col, "label", "fit", "role", "prob"), errors
