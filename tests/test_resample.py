import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortsmith.operators import resample as RS
from cohortsmith.operators import neighbors as NB
from cohortsmith.operators.neighbors import nearest_rows, pivot_requests, recall


def cloud(n=300, d=3, seed=1, copies=True):
    """Points with a third of all rows identical and several tight clusters."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + rng.integers(0, 4, (n, 1)) * 5
    if copies:
        x[: n // 3] = [1.0, 2.0, 3.0][:d]
    x = np.round(x, 3)
    return pd.DataFrame({"id": np.arange(n), "label": (rng.random(n) < 0.3).astype(int), "x": list(map(list, x))})


def brute(q, p, k):
    out = {}
    pv = np.array(p["x"].tolist())
    for i, v in zip(q["id"], q["x"]):
        d = ((np.array(v) - pv) ** 2)
        d = d[:, 0] + d[:, 1] + d[:, 2]
        order = sorted((dd, j) for dd, j in zip(d, p["id"]) if j != i)[:k]
        out[i] = [j for _, j in order]
    return out


@pytest.mark.parametrize("search, block", [({}, 8_192), ({"pivots": 1}, 40), ({"pivots": 9}, 15), ({"pivots": 200}, 8_192)])
def test_nearest_rows_match_brute_force(spark, monkeypatch, search, block):
    monkeypatch.setattr(NB, "POINTS", block)
    monkeypatch.setattr(NB, "QUERIES", block)
    monkeypatch.setattr(NB, "BLOCK_CELLS", block * 3)
    pdf = cloud()
    df = spark.createDataFrame(pdf)
    q = df.filter("label = 1")
    got = nearest_rows(q, df, 5, "id", "x", tag_col="label", **search).toPandas()
    exp = brute(pdf[pdf.label == 1], pdf, 5)
    ranked = got.sort_values(["id", "nb_rank"]).groupby("id")["nb_id"].apply(list).to_dict()
    assert ranked == exp
    tags = dict(zip(pdf["id"], pdf["label"]))
    assert all(tags[n] == t for n, t in zip(got["nb_id"], got["nb_tag"]))


@pytest.mark.parametrize("method", ["exact", "lsh"])
def test_rounds_bound_what_is_shuffled(spark, monkeypatch, method):
    """Blocks of 20 rows in rounds of a few hundred vectors find what brute force finds, and each round's best are released."""
    monkeypatch.setattr(NB, "POINTS", 20)
    monkeypatch.setattr(NB, "QUERIES", 20)
    pdf = cloud()
    df = spark.createDataFrame(pdf)
    made, gone = [], []
    fresh, release = NB.fresh_folder, NB.release
    monkeypatch.setattr(NB, "fresh_folder", lambda s: made.append(fresh(s)) or made[-1])
    monkeypatch.setattr(NB, "release", lambda s, f: gone.extend(f) or release(s, f))
    monkeypatch.setattr(NB, "ROUND_ROWS", 600)
    search = {"tables": 2, "probes": 1} if method == "lsh" else {"pivots": 4}
    got = nearest_rows(df, df, 5, "id", "x", method=method, vectors=False, **search)
    assert got.columns == ["id", "nb_id", "nb_rank", "dist2", "nb_tag"]
    ranked = got.toPandas().sort_values(["id", "nb_rank"]).groupby("id")["nb_id"].apply(list).to_dict()
    assert ranked == brute(pdf, pdf, 5)
    assert len(gone) > 2 and set(gone) < set(made)


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-3, 100.0), (1e200, 0.0), (0.0, 7.0)])
def test_nearest_of_computes_the_near_pairs_exactly(scale, shift):
    rng = np.random.default_rng(3)
    a, b = (rng.normal(size=(n, 20)) * scale + shift for n in (60, 900))
    b[:300], a[:10] = b[5], b[:10]
    for k, points in ((1, b), (6, b), (6, b[:5]), (6, np.where(b > 2 * scale + shift, np.nan, b))):
        with np.errstate(over="ignore"):
            d = NB.squared_distances(a, points)
            row, column = NB.first_k(d, k)
            got = [np.concatenate(x) for x in zip(*NB.nearest_of(a, points, k))]
        assert np.array_equal(row, got[0]) and np.array_equal(column, got[1]) and np.array_equal(d[row, column], got[2], equal_nan=True)


def test_single_precision_gives_the_rows_of_double_precision(spark):
    pdf = cloud(d=5, copies=False)
    df = spark.createDataFrame(pdf).withColumn("y", F.col("x").cast("array<float>"))
    wide = df.withColumn("x", F.col("y").cast("array<double>"))
    one = nearest_rows(wide.drop("x"), wide.drop("x"), 3, "id", "y")
    two = nearest_rows(wide, wide, 3, "id", "x")
    assert one.schema["nb_vec"].dataType == two.schema["nb_vec"].dataType
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_nearest_rows_with_fewer_points_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id long, x array<double>")
    got = nearest_rows(df, df, 10, "id", "x", pivots=2)
    assert got.groupBy("id").count().select("count").distinct().collect()[0][0] == 2


def clustered(spark, n=3_000, d=64, seed=2):
    """Sixty clusters in 64 dimensions."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, d))[rng.integers(0, 60, n)] * 4 + rng.normal(size=(n, d)) * 0.3
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": list(map(list, x))}))


def test_exact_search_asks_few_cells_of_clusters(spark):
    df = clustered(spark)
    queries, points = df.select(F.col("id").alias("qid"), F.col("x").alias("qvec")), df.select("id", F.col("x").alias("vec"))
    _, _, requests = pivot_requests(queries, points, 6, pivots=50)
    assert requests.columns == ["qid", "cell"]
    assert requests.count() < 0.1 * 3_000 * 50


@pytest.mark.parametrize("spread", [0.3, 4.0])
def test_lsh_recall(spark, spread):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4_000)] * 4 + rng.normal(size=(4_000, 16)) * spread
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(4_000), "x": list(map(list, np.vstack([x[:3_000], np.tile(x[0], (1_000, 1))])))}))
    q = df.filter("id % 20 = 0")
    exact = nearest_rows(q, df, 5, "id", "x")
    found = nearest_rows(q, df, 5, "id", "x", method="lsh", tables=12, bucket_rows=400)
    r = recall(found, exact).first()
    assert r["wanted"] == 5 * 200 and r["recall"] >= 0.9
    assert found.count() == exact.count()


def test_lsh_answers_whole_where_buckets_are_small(spark):
    df = spark.createDataFrame(cloud())
    got = nearest_rows(df, df, 5, "id", "x", method="lsh", tables=1, bucket_rows=2, probes=0)
    assert got.groupBy("id").count().filter("count = 5").count() == 300
    assert nearest_rows(df.limit(0), df, 5, "id", "x", method="lsh").count() == 0
    assert nearest_rows(df, df.limit(0), 5, "id", "x").count() == 0


def test_unknown_method(spark):
    df = spark.createDataFrame(cloud())
    with pytest.raises(ValueError, match="method"):
        nearest_rows(df, df, 5, "id", "x", method="guess")


def test_smote_rows_lie_between_minority_rows(spark):
    pdf = cloud(copies=False)
    df = spark.createDataFrame(pdf)
    made = RS.smote(df, "id", "x", k=3).toPandas()
    n_min, n_maj = int((pdf.label == 1).sum()), int((pdf.label == 0).sum())
    assert len(made) == n_maj - n_min
    by_id = {i: np.array(x) for i, x in zip(pdf["id"], pdf["x"])}
    minority = set(pdf[pdf.label == 1]["id"])
    for r in made.itertuples():
        assert r.base_id in minority and r.nb_id in minority and 0 <= r.u < 1
        assert np.allclose(r.features, by_id[r.base_id] + r.u * (by_id[r.nb_id] - by_id[r.base_id]))
    again = RS.smote(df.repartition(5), "id", "x", k=3).select("synth_id", "base_id", "nb_id").toPandas()
    assert {tuple(r) for r in again.itertuples(index=False)} == {tuple(r) for r in made[["synth_id", "base_id", "nb_id"]].itertuples(index=False)}


def test_tiny_minorities(spark):
    rows = [(i, 0, [float(i)]) for i in range(6)] + [(10, 1, [0.5])]
    one = spark.createDataFrame(rows, "id long, label int, x array<double>")
    for make in (RS.smote, RS.borderline_smote, RS.adasyn):
        assert make(one, "id", "x").count() == 0
    two = spark.createDataFrame(rows + [(11, 1, [2.5])], "id long, label int, x array<double>")
    assert RS.smote(two, "id", "x").count() == 4
    assert {r["nb_id"] for r in RS.smote(two, "id", "x").collect()} <= {10, 11}


def test_borderline_bases_are_in_danger(spark):
    df = spark.createDataFrame(cloud(copies=False))
    danger = {r["id"] for r in RS.danger_rows(df, "id", "x", m=6).collect()}
    assert danger
    assert {r["base_id"] for r in RS.borderline_smote(df, "id", "x", m=6).collect()} <= danger


def test_adasyn_follows_quota(spark):
    df = spark.createDataFrame(cloud(copies=False))
    quota = {r["id"]: r["quota"] for r in RS.adasyn_quota(df, "id", "x").collect() if r["quota"] > 0}
    made = RS.adasyn(df, "id", "x").groupBy("base_id").agg(F.count("*").alias("n"))
    assert {r["base_id"]: r["n"] for r in made.collect()} == quota


def test_balanced_bags(spark):
    df = spark.createDataFrame(cloud())
    bags = RS.balanced_bags(df, "id", bags=7)
    sums = {(r["bag"], r["label"]): r["s"] for r in bags.groupBy("bag", "label").agg(F.sum("multiplicity").alias("s")).collect()}
    assert len(sums) == 14 and len(set(sums.values())) == 1


def test_draws_reach_beyond_32_bits(spark):
    """The draw modulo a class of more than 2^32 rows takes ranks of its upper part too."""
    from pyspark.sql import functions as F

    from cohortsmith.functions.hashing import hash_int

    size = 3 * 2**33
    at = spark.range(2_000).select((hash_int(42, F.col("id")) % size + 1).alias("rank"))
    assert at.filter(F.col("rank") > 2**34).count() > 500
    assert at.filter(F.col("rank") < 2**32).count() > 200


def test_first_of_a_block_and_its_distances(monkeypatch):
    """Tiles change no distance; the k least are those of a whole stable sort, ties and not-a-numbers included."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(37, 5)), rng.normal(size=(91, 5))
    monkeypatch.setattr(NB, "TILE_ROWS", 8)
    monkeypatch.setattr(NB, "TILE_COLUMNS", 16)
    want = np.zeros((37, 91))
    for j in range(5):
        want += (a[:, j, None] - b[None, :, j]) ** 2
    assert (NB.squared_distances(a, b) == want).all()
    d = np.where(rng.random(want.shape) < 0.1, np.nan, np.round(want))
    d[3] = np.nan
    for k in (1, 6, 91, 200):
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        row, column = NB.first_k(d, k)
        assert (row == np.repeat(np.arange(37), best.shape[1])).all() and (column == best.ravel()).all()
