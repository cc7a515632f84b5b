import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortsmith.operators import models as MD
from cohortsmith.operators import multifit as MF
from cohortsmith.operators.shape import array_features
from cohortsmith.operators.weights import weigh_for_fit
from cohortsmith.plans import flows


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    n, p = 240, 9
    y = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(size=(n, p)) * np.linspace(1, 4, p) + 2
    x[:, 0] += 1.5 * y
    x[:, 4] -= 3 * y
    gaps = rng.random((n, p)) < 0.04
    views = np.stack([rng.integers(-1, 3, n), rng.integers(-1, 2, n)], axis=1)
    return y, x, gaps, views


@pytest.fixture(scope="module")
def rows(spark, data):
    y, x, gaps, views = data
    made = [(i, int(y[i]), [None if g else float(v) for v, g in zip(x[i], gaps[i])], [int(v) for v in views[i]]) for i in range(len(y))]
    return spark.createDataFrame(made, "row_id long, label int, x array<double>, views array<int>").repartition(3).persist()


def recipe(x, k):
    return MF.Recipe(tuple(range(k)), tuple(np.full(k, 1.5)), tuple(x[:, :k].mean(axis=0)), tuple(x[:, :k].std(axis=0)))


def by_spark(spark, data, fit):
    """The same model by Spark ML, on rows filled and scaled in numpy."""
    y, x, gaps, views = data
    seen = (views[:, fit.view] != -1) & (views[:, fit.view] != fit.held)
    k = len(fit.recipe.positions)
    z = (np.where(gaps, 1.5, x)[:, :k] - np.array(fit.recipe.mean)) / np.array(fit.recipe.sd)
    made = [(int(a), [float(v) for v in b]) for a, b in zip(y[seen], z[seen])]
    df = weigh_for_fit(array_features(spark.createDataFrame(made, "label int, x array<double>"), "x"))[0]
    model = MD.fit_logistic(df, fit.c, fit.l1, max_iter=2_000)
    p = 1 / (1 + np.exp(-(z @ model.coefficients.toArray() + model.intercept)))
    return np.append(model.coefficients.toArray(), model.intercept), p


def test_equals_spark_fit_by_fit(spark, data, rows, monkeypatch):
    monkeypatch.setattr(MF, "CELLS", 250)  # a few models a pass
    monkeypatch.setattr(MF, "STEP", 70)
    x = data[1]
    fits = [MF.Fit(v, g, recipe(x, k), c, l1) for v, g, k, c, l1 in [(0, 0, 9, 0.5, False), (0, -1, 4, 2.0, False), (1, 1, 9, 0.05, True), (1, -1, 9, 0.2, True), (0, 2, 1, 1.0, False)]]
    done = MF.fit_many(rows, MF.weigh(rows, fits))
    scored = MF.score_many(rows, done, ["row_id"], trained=True).toPandas()
    for n, d in enumerate(done):
        coefficients, p = by_spark(spark, data, d.fit)
        assert np.allclose(d.coefficients, coefficients, atol=2e-4), n
        if d.fit.l1:
            assert (d.coefficients[:-1] == 0).tolist() == (np.abs(coefficients[:-1]) < 1e-5).tolist()
        own = scored[scored["fit"] == n]
        fold = data[3][own["row_id"], d.fit.view]
        assert (own["role"] == np.where(fold == d.fit.held, "test", "train")).all()
        want = {i for i, f in enumerate(data[3][:, d.fit.view]) if f != -1 or d.fit.held == -1}
        assert set(own["row_id"]) == want and len(own) == len(want)
        assert np.allclose(own["prob"], p[own["row_id"]], atol=1e-3)


def test_leave_one_out_is_near_true_refits(rows, data):
    """185 rows: the largest error of the one-pass scores against 185 true refits."""
    few = rows.filter("row_id < 185").withColumn("views", F.array(F.lit(0))).persist()
    fit = MF.weigh(few, [MF.Fit(0, -1, recipe(data[1], 9), 0.5)])[0]
    whole = MF.fit_many(few, [fit])[0]
    got = {r["row_id"]: r["prob"] for r in MF.leave_one_out(few, whole, ["row_id"]).collect()}
    # True refits, all in shared passes: row i is the inner fold i of the one view.
    own = few.withColumn("views", F.array(F.col("row_id").cast("int")))
    refits = MF.fit_many(own, [MF.Fit(0, i, fit.recipe, 0.5, weights=fit.weights, total=fit.total) for i in range(185)])
    true = {r["row_id"]: r["prob"] for r in MF.score_many(own, refits, ["row_id"]).collect()}
    naive = {r["row_id"]: r["prob"] for r in MF.score_many(few, [whole], ["row_id"], trained=True).collect()}
    off = np.array([got[i] - true[i] for i in range(185)])
    assert len(got) == len(true) == 185 and np.abs(off).max() < 5e-3
    assert np.abs(off).max() < 0.1 * max(abs(naive[i] - true[i]) for i in range(185))


def test_leave_one_out_flow(spark, rows):
    got = flows.logistic_leave_one_out(rows, "row_id", "x", top=5)
    assert got.count() == 240 and got.filter("prob between 0 and 1").count() == 240


def test_errors(rows, data):
    one_class = rows.filter("label = 1")
    with pytest.raises(ValueError, match="one class"):
        MF.weigh(one_class, [MF.Fit(0, 0, recipe(data[1], 2), 1.0)])
    with pytest.raises(ValueError, match="positive"):
        MF.fit_many(rows, MF.weigh(rows, [MF.Fit(0, 0, recipe(data[1], 2), -1.0)]))
    with pytest.raises(ValueError, match="order of their rank"):
        MF.recipe_of([{"rank": 2, "feature": "1", "fill": 0, "mean": 0, "sd": 1}, {"rank": 1, "feature": "0", "fill": 0, "mean": 0, "sd": 1}])


def test_joint_and_single_fits_agree(rows):
    """The shared passes choose and score as fits one by one do."""
    grid = {"k": (3, 9), "c": (0.1, 1.0)}
    kw = {"grid": grid, "k_outer": 2, "repeats": 2, "k_inner": 2, "n_iter": 4, "l1_c": 0.5}
    joint = flows.nested_study(rows, "row_id", "x", **kw)
    single = flows.nested_study(rows, "row_id", "x", **{**kw, "grid": {**grid, "max_iter": (2_000,)}})
    a, b = ({(r["repeat"], r["fold"]): r for r in s.records.collect()} for s in (joint, single))
    assert set(a) == set(b) == {(r, f) for r in range(2) for f in range(2)}
    for key, r in a.items():
        assert r["status"] == "search" and r["n_selected"] == b[key]["n_selected"]
        assert r["best_params"].replace("}", ', "max_iter": 2000}') == b[key]["best_params"] or abs(r["roc_auc"] - b[key]["roc_auc"]) < 0.02
        assert abs(r["roc_auc"] - b[key]["roc_auc"]) < 0.02


@pytest.mark.parametrize("model, grid", [("LogisticRegression", {"k": (4,), "c": (-1.0, -2.0)}), ("RandomForest", {"k": (4,), "trees": (3,), "depth": (99, 98)})])
def test_a_failed_search_falls_back_to_the_defaults(rows, model, grid, monkeypatch):
    s = flows.nested_study(rows, "row_id", "x", model=model, grid=grid, k_outer=2, repeats=1, k_inner=2, n_iter=2)
    got = s.records.collect()
    assert [r["status"] for r in got] == ["fallback"] * 2 and s.errors
    assert all(r["best_params"] == '{"k": 4}' and r["roc_auc"] > 0.7 for r in got)


def test_search_lists_with_a_tuned_neighbour_count(rows):
    from cohortsmith.operators.tuning import search_lists

    grid = {c: v[:1] for c, v in search_lists("focused", "LogisticRegression", 9).items()} | {"k": (6,), "smote_k": (1, 2)}
    s = flows.nested_study(rows, "row_id", "x", grid=grid, resampler="smote", k_outer=2, repeats=1, k_inner=2, n_iter=2)
    assert not s.errors and all(r["status"] == "search" and '"smote_k": ' in r["best_params"] for r in s.records.collect())


def test_components_then_best_then_l1(rows):
    s = flows.nested_study(rows, "row_id", "x", grid={"k": (5,), "c": (0.5,)}, pre_pca=7, l1_c=0.5, k_outer=2, repeats=1, n_iter=1)
    assert not s.errors and all(r["status"] == "single" and r["roc_auc"] > 0.7 for r in s.records.collect())
