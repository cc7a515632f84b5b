"""Many penalised logistic regressions in shared passes over the rows.

A search fits one model for each candidate, fold and repeat, on mostly the same rows. Here a pass
reads the rows once, and each task adds up loss, gradient and curvature of all models at their present
coefficients; the driver takes a Newton step for each (for L1: the minimum of the penalised quadratic
model, by coordinates). Some ten passes fit hundreds of models, where fits of their own would read
the rows some ten times each. The penalty is that of `models.fit_logistic`.

Rows carry id, label, x (features, null where missing) and views: for each outer test fold of each
repeat the row's inner fold, or -1 where the row is in that test fold.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import task_count

# Tasks receive these functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PASSES, SETTLED = 60, 1e-9
#: Numbers that a task adds up in one pass; more models take more passes.
CELLS = 1 << 23
#: Rows that a task compares with all models at once.
STEP = 2_000


@dataclass(frozen=True)
class Recipe:
    """Features by position in x, and how they are filled and scaled."""

    positions: tuple[int, ...]
    fill: tuple[float, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...]

    def first(self, k: int) -> Recipe:
        return Recipe(self.positions[:k], self.fill[:k], self.mean[:k], self.sd[:k])

    def only(self, kept: Sequence[int]) -> Recipe:
        return Recipe(*(tuple(v[i] for i in kept) for v in (self.positions, self.fill, self.mean, self.sd)))


def recipe_of(rows: Sequence[dict]) -> Recipe:
    """From the rows of plans.recipes.recipe_rows, in the order of their rank."""
    if [r["rank"] for r in rows] != sorted(r["rank"] for r in rows):
        raise ValueError("recipe rows must be in the order of their rank")
    return Recipe(*(tuple(kind(r[c]) for r in rows) for c, kind in (("feature", int), ("fill", float), ("mean", float), ("sd", float))))


@dataclass(frozen=True)
class Fit:
    """One model: trained on the rows of a view whose inner fold is not `held` (-1: all of them), with
    weights by class and the penalty 1 / (c * sum of weights)."""

    view: int
    held: int
    recipe: Recipe
    c: float
    l1: bool = False
    weights: tuple[float, float] = (1.0, 1.0)
    total: float = 0.0

    @property
    def reg(self) -> float:
        if not self.c > 0:
            raise ValueError(f"c must be positive, not {self.c}")
        return 1.0 / (self.c * self.total)


@dataclass
class Fitted:
    """Coefficients (the intercept last), the curvature of the whole loss there, and passes taken."""

    fit: Fit
    coefficients: np.ndarray
    curvature: np.ndarray
    passes: int


def weigh(rows: DataFrame, fits: Sequence[Fit], balanced: bool = True) -> list[Fit]:
    """The fits with their class weights (n / (2 * class size), or 1) and sums, from one count."""
    views = rows.select("label", F.posexplode("views").alias("view", "fold"))
    n: dict[tuple[int, int], list[int]] = {}
    for r in views.groupBy("view", "fold", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        n.setdefault((r["view"], r["fold"]), [0, 0])[int(r["label"])] += r["n"]
    out = []
    for fit in fits:
        of = [c for (v, f), c in n.items() if v == fit.view and f not in (-1, fit.held)]
        a, b = sum(c[0] for c in of), sum(c[1] for c in of)
        if not a or not b:
            raise ValueError(f"view {fit.view} without fold {fit.held} has one class")
        w = ((a + b) / (2 * a), (a + b) / (2 * b)) if balanced else (1.0, 1.0)
        out.append(replace(fit, weights=w, total=a * w[0] + b * w[1]))
    return out


def _prepared(x: np.ndarray, recipe: Recipe) -> np.ndarray:
    """Filled and scaled features with a column of ones."""
    part = x[:, list(recipe.positions)]
    part = np.where(np.isnan(part), np.array(recipe.fill), part)
    return np.hstack([(part - np.array(recipe.mean)) / np.array(recipe.sd), np.ones((len(x), 1))])


def _columns(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(b["x"].tolist(), dtype="float64").reshape(len(b), -1)
    return x, np.array(b["views"].tolist(), dtype="int64").reshape(len(b), -1)


def _expit(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _groups(fits: Sequence[Fit]) -> dict[tuple[int, int, Recipe], list[int]]:
    """Fits that see the same rows and columns."""
    out: dict[tuple[int, int, Recipe], list[int]] = {}
    for i, f in enumerate(fits):
        out.setdefault((f.view, f.held, f.recipe), []).append(i)
    return out


def _sums(rows: DataFrame, fits: Sequence[Fit], at: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and curvature of each model's weighted training loss, as sums over rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = _groups(fits)
        size = [len(w) for w in at]
        total = [np.zeros(1 + n + n * n) for n in size]
        for whole in batches:
            for lo in range(0, len(whole), STEP):
                b = whole.iloc[lo : lo + STEP]
                x, views = _columns(b)
                y = b["label"].to_numpy().astype("float64")
                for (view, held, recipe), members in groups.items():
                    mask = (views[:, view] != -1) & (views[:, view] != held)
                    if not mask.any():
                        continue
                    z, target = _prepared(x[mask], recipe), y[mask]
                    for i in members:
                        margin = z @ at[i]
                        p = _expit(margin)
                        w = np.where(target == 1, fits[i].weights[1], fits[i].weights[0])
                        n = size[i]
                        t = total[i]
                        t[0] += (w * (np.logaddexp(0, margin) - target * margin)).sum()
                        t[1 : 1 + n] += z.T @ (w * (p - target))
                        t[1 + n :] += (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()
        for i, t in enumerate(total):
            yield pd.DataFrame({"i": [i], "v": [t]})

    parts = rows.select("label", "x", "views").coalesce(task_count(rows.sparkSession)).mapInPandas(run, "i int, v array<double>")
    got = {r["i"]: r["v"].toArray() for r in parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()}
    out = []
    for i, w in enumerate(at):
        v, n = got[i], len(w)
        out.append((v[0], v[1 : 1 + n], v[1 + n :].reshape(n, n)))
    return out


def _l1_step(b: np.ndarray, g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    """The minimum of the quadratic model plus reg * |b|, by coordinates; the last one is free."""
    new, slope = b.copy(), g.copy()
    curve = np.maximum(np.diag(h), 1e-12)
    for _ in range(2_000):
        moved = 0.0
        for j in range(len(b)):
            whole = curve[j] * new[j] - slope[j]
            to = whole / curve[j] if j == len(b) - 1 else np.sign(whole) * max(abs(whole) - reg, 0.0) / curve[j]
            d = to - new[j]
            if d:
                new[j] = to
                slope += h[:, j] * d
                moved = max(moved, abs(d) * curve[j] ** 0.5)
        if moved < 1e-11:
            break
    return new


def _residual(fit: Fit, b: np.ndarray, g: np.ndarray) -> float:
    """How far the optimality conditions are from holding."""
    inner, slope = b[:-1], g[:-1]
    if fit.l1:
        off = np.where(inner == 0, np.maximum(np.abs(slope) - fit.reg, 0), np.abs(slope + fit.reg * np.sign(inner)))
    else:
        off = np.abs(slope + fit.reg * inner)
    return float(max(off.max(initial=0), abs(g[-1])))


def fit_many(rows: DataFrame, fits: Sequence[Fit]) -> list[Fitted]:
    """All models, in the order of `fits`. A model that does not settle raises."""
    out: dict[int, Fitted] = {}
    now = {i: np.zeros(len(f.recipe.positions) + 1) for i, f in enumerate(fits)}
    before: dict[int, tuple[float, np.ndarray]] = {}
    for n in range(1, PASSES + 1):
        todo = [i for i in now if i not in out]
        while todo:
            part, cells = [], 0
            while todo and (not part or cells + len(now[todo[0]]) ** 2 <= CELLS):
                cells += len(now[todo[0]]) ** 2
                part.append(todo.pop(0))
            for i, (loss, g, h) in zip(part, _sums(rows, [fits[i] for i in part], [now[i] for i in part])):
                fit, b = fits[i], now[i]
                loss, g, h = loss / fit.total, g / fit.total, h / fit.total
                inner = b[:-1]
                value = loss + fit.reg * (np.abs(inner).sum() if fit.l1 else (inner**2).sum() / 2)
                if _residual(fit, b, g) <= SETTLED:
                    out[i] = Fitted(fit, b, h * fit.total, n)
                    continue
                if i in before and value > before[i][0] + 1e-12 * (1 + abs(value)):
                    now[i] = (before[i][1] + b) / 2  # the step was too long
                    continue
                before[i] = (value, b)
                if fit.l1:
                    now[i] = _l1_step(b, g, h, fit.reg)
                else:
                    ridge = np.append(np.full(len(inner), fit.reg), 1e-12)
                    now[i] = b - np.linalg.solve(h + np.diag(ridge), g + np.append(fit.reg * inner, 0.0))
        if len(out) == len(now):
            return [out[i] for i in sorted(out)]
    raise ValueError(f"{len(now) - len(out)} models did not settle in {PASSES} passes")


def score_many(rows: DataFrame, fitted: Sequence[Fitted], keep: Sequence[str] = (), trained: bool = False) -> DataFrame:
    """keep..., label, fit, role, prob: every row that a model left out, scored by it (role test), and
    with `trained` those it saw (role train). All models score in one pass."""
    models = [(f.fit, f.coefficients) for f in fitted]
    groups = _groups([f.fit for f in fitted])
    fields = [*(rows.schema[c] for c in keep), rows.schema["label"]]
    schema = T.StructType([*fields, T.StructField("fit", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("prob", T.DoubleType())])
    names = [*keep, "label"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), STEP):
                b = whole.iloc[lo : lo + STEP]
                x, views = _columns(b)
                for (view, held, recipe), members in groups.items():
                    fold = views[:, view]
                    for role, mask in (("test", fold == held), ("train", (fold != -1) & (fold != held))):
                        if not mask.any() or role == "train" and not trained:
                            continue
                        z = _prepared(x[mask], recipe)
                        for i in members:
                            own = b.loc[mask, names].reset_index(drop=True)
                            yield own.assign(fit=np.int32(i), role=role, prob=_expit(z @ models[i][1]))

    return rows.select(*dict.fromkeys([*names, "x", "views"])).mapInPandas(run, schema)


def leave_one_out(rows: DataFrame, fitted: Fitted, keep: Sequence[str] = ()) -> DataFrame:
    """keep..., label, prob: for each row the model trained, the score of the L2 model without it, in one pass.

    Taking out row i moves the coefficients, to first order, by the inverse curvature times its
    gradient; one more Newton step's worth of curvature is taken out by a rank-one correction. The
    margin then moves by w (p - y) a / (1 - w p (1 - p) a) with a = x' H^-1 x, H the penalised
    curvature. The error is of the order of a squared, so it fades as rows outnumber features.
    """
    fit = fitted.fit
    if fit.l1:
        raise ValueError("the correction needs an L2 penalty")
    ridge = np.append(np.full(len(fitted.coefficients) - 1, fit.reg * fit.total), 1e-12)
    inverse = np.linalg.inv(fitted.curvature + np.diag(ridge))
    fields = [*(rows.schema[c] for c in keep), rows.schema["label"]]
    names = [*keep, "label"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, views = _columns(b)
            mask = (views[:, fit.view] != -1) & (views[:, fit.view] != fit.held)
            z, own = _prepared(x[mask], fit.recipe), b.loc[mask, names].reset_index(drop=True)
            y = own["label"].to_numpy().astype("float64")
            w = np.where(y == 1, fit.weights[1], fit.weights[0])
            margin = z @ fitted.coefficients
            p = _expit(margin)
            a = np.einsum("ij,jk,ik->i", z, inverse, z)
            moved = margin + w * (p - y) * a / np.maximum(1 - w * p * (1 - p) * a, 1e-9)
            yield own.assign(prob=_expit(moved))

    return rows.select(*dict.fromkeys([*names, "x", "views"])).mapInPandas(run, T.StructType([*fields, T.StructField("prob", T.DoubleType())]))
