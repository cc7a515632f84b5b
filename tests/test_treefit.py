from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortsmith.catalog import modelling
from cohortsmith.operators import treefit as TF
from cohortsmith.plans import flows


def cohort(n=300, p=8, seed=4):
    """Features 0 and 1 carry the label."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.25).astype(int)
    x = rng.normal(size=(n, p))
    x[:, 0] += 2.5 * y
    x[:, 1] -= 2 * y
    return x, y


def auc(p, y):
    a, b = p[y == 1][:, None], p[y == 0]
    return ((a > b) + 0.5 * (a == b)).mean()


@pytest.mark.parametrize("model, params", [("RandomForest", {"trees": 40, "depth": None, "min_leaf": 1}), ("BalancedRF", {"trees": 40}), ("GradientBoosting", {"rounds": 40, "depth": 3})])
def test_models_find_the_signal_in_rows_they_left_out(model, params):
    x, y = cohort()
    seen = np.arange(len(y)) < 200
    p = TF.probabilities(model, x, y, seen, params, 1)
    assert ((p >= 0) & (p <= 1)).all() and auc(p[~seen], y[~seen]) > 0.9
    assert np.array_equal(p, TF.probabilities(model, x, np.where(seen, y, 1 - y), seen, params, 1))
    with pytest.raises(ValueError, match="range"):
        TF.probabilities(model, x, y, seen, {"depth": 31}, 1)
    with pytest.raises(ValueError, match="one class"):
        TF.probabilities(model, x, np.zeros_like(y), seen, params, 1)


def test_the_first_cut_is_the_best_one():
    """One boosted tree of depth 1 is the cut that a search over all features and bins finds."""
    x, y = cohort()
    seen = np.arange(len(y)) % 3 > 0
    bins = TF.binned(x, seen)
    assert bins.max() < TF.BINS
    got = TF.boosted_margin(bins, y, seen, 1, 0.1, 1)
    sign, best = np.where(y == 1, 1.0, -1.0), (np.inf, None)
    for j in range(x.shape[1]):
        for b in range(TF.BINS - 1):
            left = bins[:, j] <= b
            sides = [s for s in (left, ~left) if (s & seen).any()]
            fit = sum(np.where(s, sign[s & seen].mean(), 0) for s in sides)
            loss = ((sign - fit)[seen] ** 2).sum()
            if len(sides) == 2 and loss < best[0] - 1e-9:
                best = (loss, fit)
    assert np.allclose(got, best[1])


def test_leaves_hold_enough_rows():
    x, y = cohort(60)
    counts = np.ones((1, 60), dtype="int64")
    got = TF.forest_scores(TF.binned(x, counts[0] > 0), y, counts, (1.0, 1.0), 30, 7, np.random.default_rng(2))
    assert np.unique(got, return_counts=True)[1].min() >= 7


@pytest.mark.parametrize("model, grid", [("RandomForest", {"k": (4,), "l1_c": (0.5,), "trees": (20, 30), "depth": (3,)})])
def test_fits_in_tasks_and_by_spark_agree(spark, monkeypatch, model, grid):
    x, y = cohort(150)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))], "id long, label int, x array<double>")
    got = {}
    for small in (True, False):
        monkeypatch.setattr(flows, "fits_a_task", lambda rows, width, small=small: small)
        s = flows.nested_study(df, "id", "x", model=model, grid=grid, k_outer=2, repeats=1, k_inner=2, n_iter=2)
        got[small] = s.records.orderBy("fold").collect()
        assert not s.errors and s.scores.count() == 150
    for a, b in zip(got[True], got[False]):
        assert a["status"] == b["status"] == "search" and a["n_selected"] == b["n_selected"]
        assert abs(a["roc_auc"] - b["roc_auc"]) < 0.08 and a["roc_auc"] > 0.85


def test_the_summary_compares_four_models_after_whole_searches(spark, monkeypatch):
    """Every study runs with the flow's own folds, repeats and candidate lists."""
    asked = []

    def study(df, *names, **options):
        asked.append(options)
        rows = spark.range(15).select((F.col("id") % 3).cast("int").alias("repeat"), (F.col("id") % 5).cast("int").alias("fold"), F.lit(options["model"]).alias("model"))
        status = F.when((F.col("fold") == 2) & (F.col("model") == "RandomForest"), "fallback").otherwise("search")
        return SimpleNamespace(records=rows.withColumns({"status": status, **{m: F.lit(0.5) + F.col("fold") / 10 for m in ("accuracy", "roc_auc", "f1")}}))

    monkeypatch.setattr(modelling, "run_nested", study)
    monkeypatch.setattr(modelling, "wide", lambda spark, sf: None)
    got = {r["model"]: (r["folds"], r["inside"]) for r in modelling.models_summary(spark, "").collect()}
    assert asked == [{"model": m} for m in ("BalancedRF", "GradientBoosting", "LogisticRegression", "RandomForest")]
    assert got == {"BalancedRF": (15, True), "GradientBoosting": (15, True), "LogisticRegression": (15, True), "RandomForest": (15, False)}
