import hashlib
from collections import Counter

import numpy as np

from cohortsmith.llm import catalog
from cohortsmith.llm import digest as D

from .edges import docs, edge_rows, empty


def test_levels_against_counting():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 6, 500), rng.integers(0, 256, 70_000), np.zeros(100), np.arange(32)):
        data = data.astype(np.uint8)
        got = D.entropy_levels(data)
        assert len(got) == len(data) - D.WINDOW + 1
        for i in list(range(min(200, len(got)))) + list(range(max(0, len(got) - 50), len(got))):
            total = sum(int(D._PART[c]) for c in Counter(data[i : i + D.WINDOW].tolist()).values())
            assert got[i] == 1000 - total * 1000 // int(D._PART[D.WINDOW])
    assert len(D.entropy_levels(np.zeros(5, np.uint8))) == 0


def test_counts_cover_every_window(spark):
    rows = edge_rows()
    total = np.zeros(D.LEVELS, int)
    for _, t, _, _ in rows:
        levels = D.entropy_levels(np.frombuffer((t or "").encode(), np.uint8))
        total += np.bincount(levels, minlength=D.LEVELS)
    texts = docs(spark, rows).selectExpr("coalesce(text, '') as text")
    assert D.level_counts(texts).tolist() == total.tolist()


def test_digest_depends_on_the_text_alone():
    ranks = np.arange(D.LEVELS)
    texts = [t.encode() for _, t, _, _ in edge_rows() if t is not None]
    together = D.fingerprints(texts, ranks)
    assert together == [D.fingerprints([t], ranks)[0] for t in texts]
    assert all((p == "") == (t == b"") for p, t in zip(together, texts))
    assert D.likeness(together[0], together[2]) == 1.0
    assert D.likeness(together[0], together[1]) > 0.8  # one changed word
    assert D.likeness(together[0], together[9 - 1]) < 0.4 and D.likeness("", "") == 1.0 and D.likeness("", together[0]) == 0.0


def check(rows, got):
    """rows in the order of the documents: each is compared with the next, the last with the first."""
    want = Counter()
    for k, (i, t) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + u[:m]
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want


def test_next_document_of_edge_rows(spark):
    rows = edge_rows()
    unique = {i: t for i, t, _, _ in rows if i is not None}
    some = [(i, unique[i]) for i in sorted(unique, reverse=True)]
    got = D.digests(docs(spark, [(i, t, None, None) for i, t in some]).repartition(3)).collect()
    check(some, got)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert len(D.digests(docs(spark, rows)).collect()) == len(rows)  # with repeated and missing ids
    one = D.digests(docs(spark, rows[:1])).first()
    assert one["near_next"] == 1.0
    assert D.digests(empty(spark)).count() == 0


def test_query(spark, sf):
    got = catalog.QUERIES["op4_rarity_digest"](spark, sf).toPandas()
    table = catalog.table(spark, sf, "documents").orderBy("doc_id", ascending=False).toPandas()
    check(list(zip(table["doc_id"], table["text"])), got.to_dict("records"))
    texts = table.set_index("doc_id")["text"]
    by_text = got.groupby(texts.loc[got["doc_id"]].to_numpy())["fingerprint"].nunique()
    assert (by_text == 1).all()
    assert (got["near_edited"] > got["near_next"]).mean() > 0.97
    assert 0.6 < got["near_edited"].mean() < 0.8


def in_order(rows):
    """Descending ids, those without one last, equal ones by descending hash."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)


def hashed(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    return [tuple(r) for r in df.collect()]


def test_ids_beyond_doubles(spark):
    rows = hashed(spark, [(2**60 + k, f"text {k} of {k % 7}") for k in range(4_000)])
    got = D.digests(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    check([r[:2] for r in in_order(rows)], got)


def test_rows_without_or_with_one_id_are_spread(spark):
    rows = hashed(spark, [(None, f"text {k}") for k in range(600)] + [(5, f"other {k}") for k in range(600)] + [(6, "six"), (4, "four"), (2**62, "big")])
    docs_ = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    check([r[:2] for r in in_order(rows)], D.digests(docs_).collect())
    sizes = [r["count"] for r in D.with_next(docs_).groupBy("bucket").count().collect()]
    assert max(sizes) < 120
    alone = hashed(spark, [(None, f"text {k}") for k in range(300)])
    check([r[:2] for r in in_order(alone)], D.digests(spark.createDataFrame([r[:2] for r in alone], "doc_id long, text string")).collect())


def test_a_text_over_one_megabyte(spark):
    rows = [(1, "many words " * 110_000), (2, "é" * 700_000), (3, None)]
    got = D.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows[::-1], got)
