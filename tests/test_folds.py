import pytest
from pyspark.sql import functions as F

from cohortsmith.operators import folds as S
from cohortsmith.operators.scale import apply_scale, moments, train_moments, train_scale_table
from cohortsmith.operators.select import anova_f, double_k_best, select_k_best
from cohortsmith.operators.weights import safe_k


@pytest.fixture(scope="module")
def cohort(spark):
    """185 rows, 101 against 84."""
    return spark.createDataFrame([(f"P{i:03d}", 1 if i < 101 else 0) for i in range(185)], "id string, label int")


def test_holdout_shares(cohort):
    got = S.assign_holdout(cohort, "id").groupBy("role", "label").count().collect()
    assert {(r["role"], r["label"]): r["count"] for r in got} == {("test", 1): 20, ("test", 0): 17, ("train", 1): 81, ("train", 0): 67}


def test_holdout_pools_single_row_classes(spark):
    df = spark.createDataFrame([(i, 1 if i == 0 else 0) for i in range(10)], "id long, label int")
    got = S.assign_holdout(df, "id", stratify="auto").groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in got} == {"test": 2, "train": 8}


def test_folds_cover_once_and_are_level(cohort):
    plan = S.fold_plan(cohort, "id", k=5, repeats=3)
    assert plan.count() == 185 * 3
    assert plan.select("id", "repeat").distinct().count() == 185 * 3
    sizes = [r["count"] for r in plan.groupBy("repeat", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    per_class = [r["count"] for r in plan.filter("label = 1").groupBy("repeat", "fold").count().collect()]
    assert max(per_class) - min(per_class) <= 1
    a = {tuple(r) for r in plan.filter("repeat = 0").select("id", "fold").collect()}
    b = {tuple(r) for r in plan.filter("repeat = 1").select("id", "fold").collect()}
    assert a != b
    again = {tuple(r) for r in S.fold_plan(cohort.repartition(9), "id", k=5).select("id", "fold").collect()}
    assert a == again


def test_wide_rows_get_the_same_plan(planted):
    ids = {tuple(r) for r in S.fold_plan(planted, "id", k=5, repeats=3).select("id", "repeat", "fold").collect()}
    rows = S.assign_folds(planted, "id", k=5, repeats=3)
    assert rows.columns == ["id", "label", "x", "repeat", "fold"]
    assert {tuple(r) for r in rows.select("id", "repeat", "fold").collect()} == ids


def test_inner_folds_never_hold_outer_test_rows(cohort):
    plan = S.fold_plan(cohort, "id", k=5)
    inner = S.inner_folds(plan, "id", 5, 3)
    own = plan.select("id", F.col("fold").alias("own"))
    assert inner.join(own, "id").filter("fold = own").count() == 0
    assert inner.count() == 185 * 4


def test_audit_and_validity(spark):
    rare = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(30)], "id long, label int")
    plan = S.fold_plan(rare, "id", k=5)
    notes = [r["note"] for r in S.fold_validity(plan).collect()]
    assert notes.count("no_positives_in_test") == 3
    audit = S.fold_audit(plan)
    assert all(r["train_size"] + r["test_size"] == 30 and r["n_minority_train"] + r["test_pos"] == 2 for r in audit.collect())
    k = {(r["n_minority_train"], r["max_k"], r["resample"]) for r in safe_k(audit).collect()}
    assert k == {(1, 0, False), (2, 1, True)}


@pytest.fixture(scope="module")
def planted(spark):
    """Feature 3 follows the label, feature 7 is constant, feature 8 doubles feature 3."""
    df = spark.range(200).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    feats = [F.sin(F.col("id") * (i + 1) * 12.9898) for i in range(9)]
    feats[3] = F.col("label") * 2.0 + F.sin(F.col("id") * 7.1) * 0.3
    feats[7] = F.lit(4.0)
    feats[8] = feats[3] * 2.0
    return df.withColumn("x", F.array(*feats))


def long_of(df, *keep):
    return df.select(*keep, F.posexplode("x").alias("feature", "value"))


def test_planted_signal_wins_and_ties_go_to_the_later_feature(planted):
    f = anova_f(long_of(planted, "label"))
    top = [r["feature"] for r in select_k_best(f, 9).orderBy("rank").collect()]
    assert set(top[:2]) == {3, 8}
    assert top[-1] == 7
    assert f.filter("feature = 7").first()["f"] is None


def test_two_filters_equal_the_smaller(planted):
    f = anova_f(long_of(planted, "label"))
    a = [tuple(r) for r in double_k_best(f, 9).orderBy("rank").select("feature", "rank").collect()]
    b = [tuple(r) for r in select_k_best(f, 9).orderBy("rank").select("feature", "rank").collect()]
    assert a == b


def test_train_moments_equal_direct_ones(planted):
    tagged = S.assign_folds(planted, "id", k=4, seed=5)
    long = long_of(tagged, "id", "label", "repeat", "fold")
    got = {(r["fold"], r["feature"]): r for r in train_moments(long, 4).collect()}
    for f in range(4):
        for r in moments(long.filter(F.col("fold") != f), ["feature"]).collect():
            g = got[(f, r["feature"])]
            assert g["n"] == r["n"]
            assert g["mean"] == pytest.approx(r["mean"], abs=1e-12)
            assert g["m2"] == pytest.approx(r["m2"], abs=1e-9)
    z = apply_scale(long, train_scale_table(train_moments(long, 4)), ["repeat", "fold"])
    assert z.count() == long.count()
    assert z.filter("feature = 7").agg(F.max(F.abs("value"))).first()[0] == 0.0
