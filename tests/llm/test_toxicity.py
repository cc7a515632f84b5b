import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import catalog
from cohortsmith.llm import toxicity as T
from cohortsmith.session import noted

from .edges import docs, edge_rows, empty, sentence


def sample(n=1000, seed=1):
    """Toxic texts hold one of two words, or a pair of harmless ones in a row."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words, toxic = sentence(rng, rng.randint(5, 60)).split(), i % 2
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["foul", "vile", "bad apple"]))
        elif i % 4:
            words += ["bad", "ok", "apple"]
        rows.append((i, toxic, i, " ".join(words), ["en", "de"][i % 4 // 2]))
    return pd.DataFrame(rows, columns=["doc_id", "toxic", "draw", "text", "lang"])


def test_pooled_maxima_are_the_filters_maxima():
    rng = np.random.default_rng(0)
    net = T.Network(rng.normal(size=(T.BUCKETS, T.DIM)).astype(np.float32), [rng.normal(size=(w, T.DIM, T.FILTERS)).astype(np.float32) for w in T.WIDTHS], rng.normal(size=T.FILTERS * len(T.WIDTHS)).astype(np.float32), np.zeros(1), 0.0)
    texts = [rng.integers(0, T.BUCKETS, n) for n in (0, 1, 2, 3, 40, 0, 7, 1, 0)]
    ids, bounds = np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)])
    want = np.zeros((len(texts), len(net.bias)))
    for i, t in enumerate(texts):
        for j, (w, f) in enumerate(zip(T.WIDTHS, net.filters)):
            for p in range(len(t) - w + 1):
                z = sum(net.embedding[t[p + o]] @ f[o] for o in range(w)) + net.bias[j * T.FILTERS : (j + 1) * T.FILTERS]
                want[i, j * T.FILTERS : (j + 1) * T.FILTERS] = np.maximum(want[i, j * T.FILTERS : (j + 1) * T.FILTERS], z)
    tables = T._tables(net)
    assert np.allclose(T._pooled_max(net, ids, bounds, tables), want, atol=1e-4)
    assert np.allclose(T._pooled(net, ids, bounds, tables)[0], want, atol=1e-4)


def test_learns_words_and_pairs():
    model = T.fit_classifier(sample())
    test = sample(200, seed=9)
    got = model.score(*T.hash_words([t.encode() for t in test["text"]]), T._tables(model.network))
    assert ((got >= T.CUT) == (test["toxic"] == 1)).mean() > 0.9
    assert ((got >= 0) & (got <= 1)).all()


def test_rows_beyond_the_sample_calibrate(spark):
    """A language with too few positives in the sample gets a threshold from the rest."""
    rows = sample(1500)
    d = docs(spark, list(rows[["doc_id", "text", "lang"]].assign(source="a").itertuples(index=False, name=None)))
    labels = spark.createDataFrame(rows[["doc_id", "toxic"]])
    part = T.training_sample(d, labels, 300)
    model = T.fit_classifier(part)
    more = T.calibration_scores(d, labels, part)(model)
    assert len(part) == 300 and len(more) == 1200 and more["toxic"].sum() == rows["toxic"].sum() - part["toxic"].sum()
    assert len(set(model.thresholds)) == 1
    assert len(set(T.fit_classifier(part, lambda m: T.calibration_scores(d, labels, part)(m)).thresholds)) == 2
    assert 300 < len(T.calibration_scores(d, labels, part, each=200)(model)) < 500


def test_all_labelled_texts_are_learnt_from(spark, monkeypatch):
    """No row is left out for their number or a text's length, and each has one role."""
    rows = sample(3000)
    rows.loc[7, "text"] = "ok " * 5_000 + "rarity " + rows.loc[7, "text"]
    d = docs(spark, list(rows[["doc_id", "text", "lang"]].assign(source="a").itertuples(index=False, name=None)))
    labels = spark.createDataFrame(rows[["doc_id", "toxic"]])
    monkeypatch.setattr(T, "SAMPLE", 100)
    learnt = T.learning_rows(d, labels).toPandas()
    assert len(learnt) == 3000 and set(learnt["role"]) == {0, 1, 2} and learnt["ids"].map(len).max() > 5_000
    calls = []
    count = T.best_thresholds
    monkeypatch.setattr(T, "best_thresholds", lambda s: calls.append(s.count()) or count(s))
    model = T.fit_on_all(d, labels, part_texts=500)
    assert calls == [(learnt["role"] == 0).sum()]
    test = sample(200, seed=9)
    got = model.score(*T.hash_words([t.encode() for t in test["text"]]), T._tables(model.network))
    assert ((got >= T.CUT) == (test["toxic"] == 1)).mean() > 0.9


def test_thresholds_are_those_of_all_scores(spark):
    rng = np.random.default_rng(4)
    raw = np.round(rng.random(3000), 2)
    rows = pd.DataFrame({"guessed": rng.integers(0, 3, 3000), "raw": raw, "toxic": (rng.random(3000) < raw**2).astype(np.int32)})
    rows.loc[rows["guessed"] == 2, "toxic"] = 0
    got = T.best_thresholds(spark.createDataFrame(rows))
    for g, d in [(-1, rows), *rows.groupby("guessed")]:
        assert got[g] == (T.best_threshold(d["raw"].to_numpy(), d["toxic"].to_numpy()), d["toxic"].sum())


def test_threshold():
    assert abs(T.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) - 0.5) < 1e-9
    assert T.best_threshold(np.array([0.6, 0.5, 0.5, 0.5]), np.array([1, 1, 0, 1])) == 0.25
    for scores, labels in (([0.5, 0.5], [1, 0]), ([0.9, 0.2], [0, 1]), ([0.5], [0]), ([], [])):
        assert T.best_threshold(np.array(scores), np.array(labels)) > max(scores, default=0)


def test_labels_of_one_class_or_none(spark):
    d = docs(spark, edge_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (0, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        model = T.fit_classifier(T.training_sample(d, labels))
        got = T.score_toxicity(d, model).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r["score"] < T.CUT and r["predicted"] == 0 for r in got)
    assert T.score_toxicity(empty(spark), model).count() == 0


def test_edge_rows(spark):
    model = T.fit_classifier(sample())
    rows = edge_rows() + [(90, "such a VILE thing", "en", "a"), (91, "vile " * 30_000, None, None)]
    d = docs(spark, rows)
    got = {(r["doc_id"], r["predicted"]) for r in T.score_toxicity(d, model).collect()}
    assert (90, 1) in got and (91, 1) in got and {p for _, p in got} == {0, 1}
    kept = T.drop_toxic(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, p in got if p == 0}
    assert T.drop_toxic(empty(spark), model).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="larger tables not present")
def test_held_out_documents(spark, sf):
    got = catalog.QUERIES["op7_cnn_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = catalog.table(spark, "/root/testdata/sf0.1", "labels").toPandas()
    m = got[got["held_out"]].merge(labels, on="doc_id")
    hit = ((m["predicted"] == 1) & (m["toxic"] == 1)).sum()
    assert hit / (m["predicted"] == 1).sum() > 0.6 and hit / (m["toxic"] == 1).sum() > 0.4
    assert ((got["score"] >= T.CUT) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()


def test_learning_leaves_texts_and_passes_nowhere(spark, monkeypatch):
    d = sample(300)
    texts = spark.createDataFrame(d[["doc_id", "text", "lang"]])
    labels = spark.createDataFrame([(int(i), int(t)) for i, t in zip(d["doc_id"], d["toxic"]) if i % 3 == 0] + [(None, 1), (0, 0)], "doc_id long, toxic int")
    plans, write = [], T.durable
    monkeypatch.setattr(T, "durable", lambda x: plans.append(x._jdf.queryExecution().optimizedPlan().toString()) or write(x))
    with noted() as folders:
        rows = T.learning_rows(texts, labels)
        assert rows.count() == 100
        now = T.begin(np.zeros(T.BUCKETS), np.full(T.BUCKETS, T.LEAST_TEXTS), 0.5, np.random.default_rng(0))
        parts = rows.select(F.pmod("draw", F.lit(2)).cast("int").alias("part"), "draw", "toxic", "ids")
        then = T._spread_epoch(parts, now, np.arange(T.BUCKETS) % 2 == 0, 0)
    # Words are hashed below the join, so no text is dealt out; a pass leaves only the learning rows.
    assert 0 <= plans[0].find("Join") < plans[0].find("MapInArrow")
    assert [os.path.exists(f) for f in folders] == [True, False]
    moved = (then.p["embedding"] != now.p["embedding"]).any(axis=1)
    assert moved.any() and not moved[1::2].any()


@pytest.mark.parametrize("cells", [64, T.CELLS])
def test_every_labelled_row_is_found(spark, monkeypatch, cells):
    monkeypatch.setattr(T, "CELLS", cells)
    labels = spark.range(-3001, 3001, 7).withColumnRenamed("id", "doc_id")
    n, bits = T._label_cells(labels)
    assert n <= cells and len(bits) == n // 8
    ids = spark.range(-3000, 3000).select("id", T._cell(F.col("id").cast("int"), n).alias("place")).toPandas()
    got = set(ids["id"][T._in_cells(ids["place"].to_numpy(), bits)])
    assert got >= set(range(-2994, 3000, 7))
    assert cells == 64 or len(got) < 1300
    n, bits = T._label_cells(labels.limit(0))
    assert not T._in_cells(np.arange(n), bits).any()
