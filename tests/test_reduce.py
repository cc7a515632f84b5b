import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortsmith.operators import reduce as PC
from cohortsmith.operators.shape import array_features


def frame(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return array_features(spark.createDataFrame(rows, "id long, x array<double>"), "x").drop("x")


def exact(x, k, scale=False):
    c = x - x.mean(axis=0)
    if scale:
        c = c / x.std(axis=0, ddof=1)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    return s[:k] ** 2 / (s**2).sum(), v[:k].T


def same_space(a, b):
    return np.allclose(np.linalg.svd(a.T @ b)[1], 1, atol=1e-8)


def test_krylov_equals_the_decomposition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64)) * np.linspace(3, 1, 64) + 5
    for scale in (False, True):
        model = PC.fit_pca(frame(spark, x), 10, scale=scale, solver="krylov")
        share, pc = exact(x, 10, scale)
        assert np.allclose(model.explained, share, rtol=1e-9) and same_space(model.pc, pc)


def test_krylov_restarts(spark, monkeypatch):
    monkeypatch.setattr(PC, "BLOCKS", 2)
    monkeypatch.setattr(PC, "OVERSAMPLE", 2)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 40)) * 0.9 ** np.arange(40)
    model = PC.fit_pca(frame(spark, x), 3, solver="krylov")
    share, pc = exact(x, 3)
    assert np.allclose(model.explained, share, rtol=1e-8) and same_space(model.pc, pc)


@pytest.mark.parametrize("solver", ["gram", "krylov"])
def test_more_columns_than_rows(spark, solver, monkeypatch):
    monkeypatch.setattr(PC, "CHUNK", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 230)) + rng.normal(size=230)
    model = PC.fit_pca(frame(spark, x), 12, solver=solver)
    share, pc = exact(x, 12)
    assert np.allclose(model.explained, share, rtol=1e-8) and same_space(model.pc, pc)
    assert PC.fit_pca(frame(spark, x), 100, solver=solver).k == 29


def test_as_wide_as_the_cohort(spark):
    """185 rows of 7,431 columns: nothing of the size of columns squared is made."""
    rng = np.random.default_rng(4)
    low = rng.normal(size=(185, 5)) @ rng.normal(size=(5, 7_431)) * 3 + rng.normal(size=(185, 7_431))
    rows = spark.createDataFrame([(i,) for i in range(185)], "id int").coalesce(1)
    table = {i: [float(v) for v in r] for i, r in enumerate(low)}
    x = F.udf(lambda i: table[i], "array<double>")
    df = array_features(rows.withColumn("x", x("id")), "x").drop("x")
    model = PC.fit_pca(df, 50)
    share, pc = exact(low, 50)
    assert model.k == 50 and np.allclose(model.explained, share, rtol=1e-7) and same_space(model.pc[:, :5], pc[:, :5])


def test_constant_columns_and_repeated_rows(spark):
    x = np.tile([[1.0, 2.0, 3.0], [2.0, 2.0, 1.0]], (20, 1))
    for solver in ("gram", "krylov"):
        model = PC.fit_pca(frame(spark, x), 2, scale=True, solver=solver)
        assert np.isclose(model.explained[0], 1)
    flat = PC.fit_pca(frame(spark, np.ones((5, 3))), 2)
    assert flat.explained.tolist() == [0.0] * flat.k


def test_fewest_components_for_a_share(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 50))
    model = PC.fit_pca_variance(frame(spark, x), 0.9)
    share = exact(x, 50)[0].cumsum()
    assert share[model.k - 1] >= 0.9 > share[model.k - 2]


def test_saves_and_projects_alike(spark, tmp_path):
    rng = np.random.default_rng(6)
    df = frame(spark, rng.normal(size=(40, 6)))
    model = PC.fit_pca(df, 3, scale=True)
    model.write().save(str(tmp_path / "pca"))
    again = PC.ComponentsModel.load(str(tmp_path / "pca"))
    a, b = ([r[0] for r in m.transform(df).orderBy("id").select(vector_to_array("components")).collect()] for m in (model, again))
    assert a == b and np.allclose(np.mean(a, axis=0), 0, atol=1e-12)


def test_unknown_solver(spark):
    with pytest.raises(ValueError, match="solver"):
        PC.fit_pca(frame(spark, np.eye(3)), 1, solver="guess")
