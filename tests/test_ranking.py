"""The distributed helpers against plain pandas, with hot groups and tiny buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortsmith.operators import ranking as R
from cohortsmith.operators.alignment import number_rows
from cohortsmith.operators.resample import repeat_rows


def skewed(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.34, 0.5, rng.lognormal(0, 3, n))
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", None], n))
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v})


def test_hash_rank_is_a_permutation_per_group(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    got = R.hash_rank(df, "id", 1, by=["g"], digits=2).toPandas()
    assert len(got) == len(pdf)
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    again = R.hash_rank(df.repartition(7), "id", 1, by=["g"], digits=1).toPandas()
    assert dict(zip(got["id"], got["rank"])) == dict(zip(again["id"], again["rank"]))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    pdf = skewed().groupby(["g", "v"], dropna=False).size().reset_index(name="c")
    pdf["g"] = pdf["g"].where(pdf["g"].notna(), None)
    df = spark.createDataFrame(pdf, "g string, v double, c long")
    got = R.running_totals(df, "v", ["c"], ["g"], descending).toPandas()
    exp = pdf.sort_values("v", ascending=not descending)
    exp["run_c"] = exp.groupby("g", dropna=False)["c"].cumsum()
    exp["tot_c"] = exp.groupby("g", dropna=False)["c"].transform("sum")
    key = ["g", "v"]
    a = got.fillna({"g": "-"}).sort_values(key)[["run_c", "tot_c"]].to_numpy()
    b = exp.fillna({"g": "-"}).sort_values(key)[["run_c", "tot_c"]].to_numpy()
    assert (a == b).all()


def test_running_totals_do_not_depend_on_bounds(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(50)], "v double, c long")
    inf = float("inf")
    results = set()
    for bounds in ([-inf, inf], [-inf, 3.0, 3.5, 40.0, inf], None):
        rows = R.running_totals(df, "v", ["c"], bounds=bounds).collect()
        results.add(tuple(sorted((r["v"], r["run_c"], r["tot_c"]) for r in rows)))
    assert len(results) == 1


def test_number_rows(spark):
    df = spark.createDataFrame([(i * i,) for i in range(500)], "k long").repartition(5)
    got = number_rows(df, "k").orderBy("k").toPandas()
    assert list(got["position"]) == list(range(1, 501))


def test_repeat_rows_in_blocks(spark):
    df = spark.createDataFrame([("a", 0), ("b", 25), ("c", 3)], "row_id string, n long")
    got = repeat_rows(df, "n", "i", block=10).groupBy("row_id").agg(F.count("*").alias("c"), F.max("i").alias("m"), F.countDistinct("i").alias("d"))
    assert {tuple(r) for r in got.collect()} == {("b", 25, 24, 25), ("c", 3, 2, 3)}
