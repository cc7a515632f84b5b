import time

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortsmith.operators import models as MD
from cohortsmith.operators import reduce as PC
from cohortsmith.operators import tuning as TU
from cohortsmith.operators.ensemble import TreeEnsembleModel, ensemble_of, walk
from cohortsmith.operators.shape import array_features
from cohortsmith.plans import scoring
from cohortsmith.plans.flows import _fit_candidate
from cohortsmith.session import fresh_folder, task_count


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.25).astype(int)
    x = rng.normal(size=(300, 8))
    x[:, 0] += 1.5 * y
    x[:, 3] -= y
    made = [(int(i), int(y[i]), [float(v) for v in x[i]]) for i in range(300)]
    return array_features(spark.createDataFrame(made, "row_id long, label int, x array<double>"), "x").drop("x").persist()


def scores(model, rows):
    return [r[0] for r in MD.score(model, rows, ["row_id"]).orderBy("row_id").select("prob").collect()]


def test_equals_the_forest_its_trees_come_from(spark, rows):
    forest = RandomForestClassifier(numTrees=7, maxDepth=6, seed=5).fit(rows)
    folder = fresh_folder(spark)
    for i, tree in enumerate(forest.trees):
        tree.write().save(f"{folder}/{i}")
    model = ensemble_of(spark, folder, [t.featureImportances.toArray() for t in forest.trees])
    assert model.n_trees == 7
    assert np.allclose(scores(model, rows), scores(forest, rows), rtol=0, atol=1e-12)
    assert np.allclose(model.importances, np.mean([t.featureImportances.toArray() for t in forest.trees], axis=0))


@pytest.mark.parametrize(
    "name, params",
    [
        ("RandomForest", {"trees": 5}),
        ("GradientBoosting", {"rounds": 4}),
        ("LogisticRegression", {"c": 0.5}),
        ("BalancedRF", {"trees": 6, "depth": None}),
        ("BalancedBagging", {"trees": 4}),
    ],
)
@pytest.mark.parametrize("pca, l1", [(None, None), (None, 0.5), (4, 0.5), (4, None)])
def test_every_kind_saves_loads_and_scores_alike(spark, rows, tmp_path, name, params, pca, l1):
    model, _ = _fit_candidate(name, rows, {**params, "k": 8}, 11, 4, pre_pca=pca, l1_c=l1)
    recipe = spark.createDataFrame([(0, 0, "a", 1, 0.0, 0.0, 1.0)], "repeat int, fold int, feature string, rank int, fill double, mean double, sd double")
    scoring.save_fitted(model, recipe, str(tmp_path / "m"))
    again, _ = scoring.load_fitted(spark, str(tmp_path / "m"))
    assert scores(again, rows) == scores(model, rows)
    assert TU.fold_auc(MD.score(again, rows, ["label"]).withColumn("g", F.lit(0)), ["g"]).first()["roc_auc"] > 0.75


def test_bags_are_balanced_and_seeded(rows):
    a, b, c = (MD.fit_balanced_bags(rows, "row_id", trees=3, seed=s) for s in (1, 1, 2))
    assert scores(a, rows) == scores(b, rows) != scores(c, rows)
    # Equal class weights in each bag: at the root every tree sees one half.
    assert np.allclose(a.nodes["value"][a.nodes["node"] == 0], 0.5)


def test_four_hundred_trees_plan_quickly(spark, rows):
    one = MD.fit_balanced_bags(rows, "row_id", trees=2)
    times = 200
    nodes = {c: np.tile(v, times) for c, v in one.nodes.items()}
    model = TreeEnsembleModel(nodes, one.importances)
    start = time.time()
    MD.score(model, rows, ["row_id"])._jdf.queryExecution().executedPlan()
    assert time.time() - start < 2
    assert np.allclose(scores(model, rows), scores(one, rows))


def test_input_columns_with_clashing_names(rows):
    model = MD.fit_balanced_bags(rows, "row_id", trees=2)
    got = model.transform(rows.withColumn("_positive", F.lit("x")).withColumn("probability", F.lit("y")))
    assert got.columns.count("probability") == 1 and got.select("_positive").first()[0] == "x"
    assert [r[0][1] for r in got.orderBy("row_id").select(vector_to_array("probability")).collect()] == scores(model, rows)


def test_walk_single_leaf_and_no_rows():
    leaf = {"tree": np.zeros(1, int), "node": np.zeros(1, int), "left": np.zeros(1, int), "right": np.zeros(1, int), "feature": -np.ones(1, int), "threshold": np.zeros(1), "value": np.array([0.25])}
    assert walk(np.zeros((3, 2)), leaf).tolist() == [0.25] * 3 and walk(np.zeros((0, 2)), leaf).tolist() == []


def test_components_then_model_reads_a_vector_column(rows):
    pca = PC.fit_pca(rows, 3)
    ready = PC.project(pca, rows).drop("features").withColumnRenamed("components", "features")
    model = MD.fit_logistic(ready, c=1.0)
    before = scores(model, ready)
    assert scores(MD.projected(model, pca), rows) == before


def test_as_many_trees_grow_at_once_as_keep_the_cores_busy(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id", "cast(id % 5 = 0 as int) as label", "array(cast(id % 7 as double), cast(id % 5 as double)) as x")
    used, run = [], MD.run_parallel
    monkeypatch.setattr(MD, "run_parallel", lambda jobs, parallelism=4: used.append(parallelism) or run(jobs, parallelism))
    train = rows.select("id", "label", array_to_vector("x").alias("features"))
    one, two = (MD.fit_balanced_bags(train, "id", trees=n, parallelism=p) for n, p in ((9, 1), (9, 64)))
    tasks = max(1, task_count(spark) // 9)
    assert used == [-(-spark.sparkContext.defaultParallelism // tasks), 64] and used[0] > 1
    assert all((one.nodes[k] == two.nodes[k]).all() for k in one.nodes)
