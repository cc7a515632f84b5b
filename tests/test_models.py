import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortsmith.operators import models as MD
from cohortsmith.operators import reduce as PC
from cohortsmith.operators import tuning as TU
from cohortsmith.operators.folds import assign_folds
from cohortsmith.operators.shape import array_features, assemble_features, explode_features
from cohortsmith.operators.weights import balanced_weights
from cohortsmith.plans import flows, scoring
from cohortsmith.plans.recipes import apply_recipe, fold_recipes, recipe_rows


@pytest.fixture(scope="module")
def cohort(spark):
    """Features 0 and 1 carry the label; 2 to 5 are noise; some cells are missing."""
    rng = np.random.default_rng(7)
    n = 120
    y = (rng.random(n) < 0.4).astype(int)
    x = rng.normal(size=(n, 6))
    x[:, 0] += 2.5 * y
    x[:, 1] -= 2.0 * y
    rows = [(int(i), int(y[i]), [None if rng.random() < 0.05 else float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label int, x array<double>").coalesce(1).persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def vectors(cohort):
    filled = cohort.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))))
    return balanced_weights(array_features(filled, "x")).drop("x").persist()


def auc_of(model, df):
    return TU.fold_auc(MD.score(model, df, ["label"]).withColumn("g", F.lit(0)), ["g"]).first()["roc_auc"]


@pytest.mark.parametrize(
    "fit",
    [
        lambda d: MD.fit_random_forest(d, trees=10),
        lambda d: MD.fit_logistic(d, c=0.5),
        lambda d: MD.fit_logistic(d, c=1.0, l1=True),
        lambda d: MD.fit_gbt(d, rounds=5, rate=0.1),
        lambda d: MD.fit_balanced_bags(d, "id", trees=3),
        lambda d: MD.fit_balanced_bags(d, "id", trees=3, all_features=True),
    ],
)
def test_models_find_the_signal(vectors, fit):
    model = fit(vectors)
    assert auc_of(model, vectors) > 0.85
    p = MD.predictions_table(model, vectors, "id")
    assert p.filter((F.col("probability") < 0) | (F.col("probability") > 1)).count() == 0
    assert p.filter(F.col("predicted") != (F.col("probability") >= 0.5).cast("int")).count() == 0


def test_importance_tables(spark, vectors):
    names = [f"f{i}" for i in range(6)]
    rf = MD.feature_importance(MD.fit_random_forest(vectors, trees=10), names, spark).collect()
    assert {rf[0]["feature"], rf[1]["feature"]} == {"f0", "f1"}
    lr = MD.fit_logistic(vectors)
    signed = MD.coefficient_importance(lr, names, spark, "signed").collect()
    assert signed[0]["feature"] == "f0" and signed[-1]["feature"] == "f1"
    assert {r["feature"] for r in MD.coefficient_importance(lr, names, spark).take(2)} == {"f0", "f1"}
    bags = MD.fit_balanced_bags(vectors, "id", trees=2)
    assert sum(r["importance"] for r in MD.feature_importance(bags, names, spark).collect()) == pytest.approx(1.0)


def test_l1_selection_and_fallback(vectors):
    kept = MD.select_l1(vectors, c=0.1)
    assert set(kept) >= {0, 1} and len(kept) < 6
    assert MD.select_l1_or_fallback(vectors, range(6), c=1e-4, fallback_k=2) == ([0, 1], "f_test")
    assert MD.select_l1_or_fallback(vectors, [3, 1, 0, 2, 5, 4], c=1e-4, fallback_k="tenth_at_most_50") == ([3], "f_test")
    with pytest.raises(ValueError, match="order of all positions"):
        MD.select_l1_or_fallback(vectors, [0, 2, 5])


def test_pca_is_centred_and_orthonormal(vectors):
    shifted = vectors.withColumn("features", F.col("features"))
    model = PC.fit_pca(shifted, 4)
    pc = model.pc
    assert np.allclose(pc.T @ pc, np.eye(4), atol=1e-9)
    out = PC.project(model, shifted).select(vector_to_array("components").alias("c"))
    assert PC.project(model, shifted).columns == [*shifted.columns, "components"]
    m = np.array([r["c"] for r in out.collect()])
    assert np.allclose(m.mean(axis=0), 0, atol=1e-9)
    assert (np.diff(m.var(axis=0)) <= 1e-12).all()
    share = PC.fit_pca_variance(shifted, 0.6)
    k = len(PC.project(share, shifted).select("components").first()[0])
    total = np.cumsum(PC.fit_pca(shifted, 6).explained)
    assert total[k - 1] >= 0.6 and (k == 1 or total[k - 2] < 0.6)
    assert len(PC.project(PC.fit_pca(shifted, 100), shifted).select("components").first()[0]) == 6


def test_recipes_equal_filling_each_training_set(spark, cohort):
    """Means, deviations and F from point masses against a fold filled for real."""
    k = 3
    tagged = assign_folds(cohort, "id", k=k, seed=1).persist()
    recipes = recipe_rows(fold_recipes(explode_features(tagged, ["label", "repeat", "fold"], "x"), k, 6))
    assert set(recipes) == {(0, f) for f in range(k)}
    for f in range(k):
        pdf = tagged.filter(F.col("fold") != f).toPandas()
        x = np.array([[np.nan if v is None else v for v in r] for r in pdf["x"]])
        y = pdf["label"].to_numpy()
        med = np.nanmedian(x, axis=0)
        x = np.where(np.isnan(x), med, x)
        for r in recipes[(0, f)]:
            c = x[:, r["feature"]]
            a, b = c[y == 0], c[y == 1]
            within = a.var() * len(a) + b.var() * len(b)
            between = len(a) * (a.mean() - c.mean()) ** 2 + len(b) * (b.mean() - c.mean()) ** 2
            assert r["fill"] == pytest.approx(med[r["feature"]])
            assert r["mean"] == pytest.approx(c.mean())
            assert r["sd"] == pytest.approx(c.std())
            assert r["f"] == pytest.approx(between / (within / (len(c) - 2)))


def test_grids():
    g = TU.param_grid("RandomForest", 60)
    assert g["k"] == (20, 30, 50) and "l1_c" in g
    assert TU.param_grid("LogisticRegression", 8)["k"] == (8,)
    assert "l1_c" not in TU.param_grid("GradientBoosting", 500)
    picked = TU.sample_params(g, 20)
    assert len({tuple(sorted(p.items(), key=str)) for p in picked}) == 20
    assert picked == TU.sample_params(g, 20)
    assert len(TU.sample_params({"k": (1, 2)}, 20)) == 2
    assert TU.pick_best([(0, 0.7), (1, 0.9), (2, 0.9), (3, None)]) == 1


def test_grid_tables(spark):
    assert TU.grid_table(spark, {"a": (1, 2), "b": (None, 3)}).count() == 4
    g = TU.model_grid(spark, ["smote", "adasyn"], ["RandomForest", "LogisticRegression"], [None, 50])
    assert g.count() == 8 and g.filter("combo = 'smote__RandomForest'").count() == 2


def test_failed_folds_score_half_and_keep_the_error(cohort):
    tagged = assign_folds(array_features(cohort.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))), "x"), "id", k=2)

    def broken(train):
        raise RuntimeError("no luck")

    got = TU.out_of_fold(tagged, broken, ["id", "label", "repeat", "fold"], [(0, 0), (0, 1)])
    assert got.errors == {(0, 0): "no luck", (0, 1): "no luck"}
    assert got.scores.filter("failed and prob = 0.5").count() == 120
    assert TU.count_failed(got.scores).first()["n_failed"] == 120
    again = TU.out_of_fold(tagged, broken, ["id", "label", "repeat", "fold"], [(0, 0)], fallback=lambda t: MD.fit_logistic(t))
    assert again.scores.filter("failed").count() == 0 and again.errors


def test_holdout_study(cohort):
    s = flows.holdout_study(cohort, "id", "x", models={"LogisticRegression": {"c": 0.5}, "RandomForest": {"trees": 5}}, top=4, k=3)
    rows = {r["model"]: r for r in s.records.collect()}
    assert set(rows) == {"LogisticRegression", "RandomForest"} and not s.errors
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == 24 and r["cv_auc_mean"] > 0.8 for r in rows.values())
    assert s.best.first()["model"] in rows


@pytest.mark.parametrize("broken", [1, 2])
def test_a_failed_fit_is_no_result_of_a_holdout_study(cohort, monkeypatch, broken):
    """The first fit is the hold-out's, the second one a fold's."""
    calls, whole = [], flows.fit_named

    def fit(*args):
        calls.append(args)
        if len(calls) == broken:
            raise ValueError("no luck")
        return whole(*args)

    monkeypatch.setattr(flows, "fit_named", fit)
    with pytest.raises(RuntimeError, match="no model of repeat 0, fold .: no luck"):
        flows.holdout_study(cohort, "id", "x", models={"LogisticRegression": {"c": 0.5}}, top=4, k=3, parallelism=1)


def test_leave_one_out_study(spark, cohort):
    few = cohort.filter("id < 14")
    s = flows.leave_one_out_study(few, "id", "x", l1_c=1.0, top=4)
    assert s.scores.count() == 14
    assert s.records.first()["roc_auc"] > 0.5


@pytest.mark.parametrize("model,grid,resampler", [("LogisticRegression", {"k": (2, 4), "c": (0.5,)}, "smote"), ("RandomForest", {"k": (4,), "l1_c": (0.5,), "trees": (5,), "depth": (3,)}, None)])
def test_nested_study(cohort, model, grid, resampler):
    s = flows.nested_study(cohort, "id", "x", model=model, grid=grid, resampler=resampler, k_outer=2, repeats=1, k_inner=2, n_iter=2)
    rows = s.records.collect()
    assert len(rows) == 2 and not s.errors
    for r in rows:
        assert r["test_size"] == 60 and r["note"] == "ok" and r["roc_auc"] > 0.75
        assert 0.0 <= r["threshold"] <= 1.0
        assert s.selected.filter((F.col("fold") == r["fold"])).count() == r["n_selected"] <= r["n_features_train"]
    assert s.selected.filter("feature in ('0', '1')").count() >= 2


def test_saved_model_scores_new_rows_and_a_stream(spark, cohort, tmp_path):
    tagged = assign_folds(cohort, "id", k=2).persist()
    recipe = fold_recipes(explode_features(tagged, ["label", "repeat", "fold"], "x"), 2, 3).filter("fold = 0").persist()
    rows = next(iter(recipe_rows(recipe).values()))
    train = apply_recipe(tagged.filter("fold = 1"), rows, ["id", "label"], "x")
    model = MD.fit_logistic(train)
    scoring.save_fitted(model, recipe, str(tmp_path / "m"))
    loaded, again = scoring.load_fitted(spark, str(tmp_path / "m"))
    assert [r["feature"] for r in again] == [r["feature"] for r in rows]
    new = tagged.filter("fold = 0").select("id", "x")
    batch = scoring.score_new(loaded, again, new, ["id"], "x")
    direct = MD.score(model, apply_recipe(new, rows, ["id"], "x"), ["id"])
    a, b = ({r[0]: r[-1] for r in d.collect()} for d in (batch, direct))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i]) for i in a)
    new.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    q = scoring.score_new(loaded, again, stream, ["id"], "x").writeStream.format("memory").queryName("scored").trigger(availableNow=True)
    run = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    assert run.awaitTermination(120)
    assert {r["id"]: r["probability"] for r in spark.table("scored").collect()} == a


def test_named_columns_serve_as_features(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 8.0)], "id int, `a.b` double, c double")
    recipe = [{"feature": "a.b", "fill": 0.0, "mean": 3.0, "sd": 1.0}, {"feature": "c", "fill": 8.0, "mean": 8.0, "sd": 2.0}]
    got = apply_recipe(df, recipe, ["id"]).select("id", vector_to_array("features").alias("f")).collect()
    assert {r["id"]: r["f"] for r in got} == {1: [-1.0, 0.0], 2: [1.0, 0.0]}
    full = df.filter("c is not null").withColumnRenamed("a.b", "a")
    assert assemble_features(full, ["a", "c"]).count() == 1


def test_grid_study_with_components(cohort):
    s = flows.grid_study(
        cohort, "id", "x", [None, "borderline"], ["LogisticRegression"], [3], k_outer=2, repeats=1, n_iter=1, grid={"k": (6,), "c": (0.5,)}
    )
    rows = s.records.collect()
    assert not s.errors
    assert {(r["combo"], r["pre_pca"], r["fold"]) for r in rows} == {(f"{m}__LogisticRegression", 3, f) for m in ("none", "borderline") for f in (0, 1)}
    assert all(r["roc_auc"] > 0.75 for r in rows)


def test_rules_for_the_number_of_features(spark):
    from cohortsmith.operators import select as SE

    rows = spark.createDataFrame([(i, float(i)) for i in range(185)], "feature int, f double")
    got = {r["rule"]: r["n"] for r in SE.by_rules(rows, 185).groupBy("rule").agg(F.count("*").alias("n")).collect()}
    assert got == {"default": 20, "at_most_50": 50, "at_most_200": 185, "tenth": 18, "fifth": 37}
    assert {r: rule(7_431) for r, rule in SE.K_RULES.items()} == {"default": 100, "at_most_50": 50, "at_most_200": 200, "tenth": 743, "fifth": 1486}
    assert {r: rule(64) for r, rule in SE.FALLBACK_RULES.items()} == {"at_most_25": 25, "tenth_at_most_50": 6, "tenth_at_most_100": 6, "all": 64}
