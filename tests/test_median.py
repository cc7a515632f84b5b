import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortsmith.operators.impute import train_medians
from cohortsmith.operators.median import exact_median, number_of, ordered_bits


def hard(n=4000, seed=1):
    """A hot group, a constant one, signs, zeros of both kinds, all magnitudes, gaps."""
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(size=n), 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n), np.full(n, 7.25), rng.choice([0.0, -0.0, 5e-324, -5e-324], n)])
    g = np.repeat(["normal", "wide", "constant", "zeros"], n)
    v[rng.random(len(v)) < 0.05] = np.nan
    return pd.DataFrame({"g": np.where(rng.random(len(v)) < 0.4, "hot", g), "v": v, "fold": rng.integers(0, 4, len(v)), "repeat": 0})


def test_bits_order_as_numbers_do(spark):
    v = [float("-inf"), -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.5, 1e300, float("inf")]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select("v", ordered_bits(F.col("v")).alias("k"))
    got = rows.orderBy("k").withColumn("back", number_of(F.col("k"))).collect()
    assert [r["v"] for r in got] == v == [r["back"] for r in got]


def test_groups(spark):
    pdf = hard()
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r["median"] for r in exact_median(df, "v", ["g"]).collect()}
    assert got == pdf.dropna().groupby("g")["v"].median().to_dict()
    assert exact_median(df, "v").first()[0] == pdf["v"].median()


@pytest.mark.parametrize("values, median", [([2.0], 2.0), ([1.0, 4.0], 2.5), ([1.0, 1.0, 9.0], 1.0), ([3.0, None, float("nan")], 3.0), ([-1.0, 1.0], 0.0)])
def test_small(spark, values, median):
    assert exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()[0] == median


def test_nothing_to_count(spark):
    assert exact_median(spark.createDataFrame([(None,), (float("nan"),)], "v double"), "v").count() == 0
    assert exact_median(spark.createDataFrame([], "g string, v double"), "v", ["g"]).count() == 0


def test_training_folds(spark):
    pdf = hard(800)
    long = spark.createDataFrame(pdf.rename(columns={"g": "feature", "v": "value"}))
    got = {(r["fold"], r["feature"]): r["median"] for r in train_medians(long, 4).collect()}
    exp = {}
    for f in range(4):
        for g, m in pdf[pdf["fold"] != f].dropna().groupby("g")["v"].median().items():
            exp[f, g] = m
    assert got == exp


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {r["g"]: r["median"] for r in exact_median(df, "v", ["g"]).collect()} == {None: 2.0, "a": 5.0}


def test_no_window(spark):
    df = spark.createDataFrame(hard(50))
    plan = exact_median(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan
