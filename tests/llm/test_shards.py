import zlib
from collections import Counter

import numpy as np
import pytest

from cohortsmith.llm import catalog
from cohortsmith.llm.shards import feistel_shards, permute, row_at

from .edges import docs, edge_rows, empty


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 65_537])
def test_permutation_and_its_inverse(n):
    x = np.arange(n)
    y = permute(x, n, key=7)
    assert sorted(y.tolist()) == x.tolist()
    assert permute(y, n, key=7, inverse=True).tolist() == x.tolist()
    if n > 90:
        assert (y != permute(x, n, key=8)).any() and (y[:-1] < y[1:]).mean() < 0.7


def test_shards_of_edge_rows(spark):
    rows = edge_rows()
    got = feistel_shards(docs(spark, rows), 4, key=3).toPandas()
    assert len(got) == len(rows)
    sizes = Counter(got["shard"])
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    facts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.size, r.text_crc32) for r in got.itertuples()) == facts
    assert all(row_at(r.shard, r.slot, len(rows), 4, 3) == r.row for r in got.itertuples())


def test_storage_does_not_matter(spark):
    d = docs(spark, edge_rows())
    key = ["doc_id", "text_crc32", "shard", "slot"]
    a, b = (feistel_shards(x, 4, key=3).select(key).toPandas() for x in (d.repartition(5), d.coalesce(1)))
    assert Counter(map(str, a.itertuples(index=False))) == Counter(map(str, b.itertuples(index=False)))


def test_empty_table(spark):
    assert feistel_shards(empty(spark), 4).count() == 0


def test_query(spark, sf):
    got = catalog.QUERIES["op6_feistel_shards"](spark, sf).toPandas()
    sizes = got.groupby("shard")["slot"].agg(["count", "max"])
    assert len(sizes) == 40 and (sizes["count"] == sizes["max"] + 1).all() and sizes["count"].max() - sizes["count"].min() <= 1
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
