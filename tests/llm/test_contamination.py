import hashlib
import random
import re

import numpy as np
import pytest

from cohortsmith.llm import catalog
from cohortsmith.llm.contamination import _own_codes, contamination, find_overlap, item_windows, match_texts, prefixes, shingle_codes

from .edges import docs, edge_rows, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)):
            if w and i is not None:
                windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for x, names in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,block_items", [(1, 100), (2, 3), (4, 100), (4, 7), (13, 100)])
def test_against_brute_force(spark, window, block_items):
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choices(["aa", "Bb", "c", "dé", "9", "ee,"], k=n))
    items = [(i, text(rng.randint(1, 9))) for i in range(20)] + [(3, "aa Bb aa"), (20, None), (21, ""), (None, "aa c"), (22, "?!")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(i, t) for i, t, _, _ in edge_rows()]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as n_words", "3 as block")
    got = contamination(find_overlap(docs(spark, [(i, t, None, None) for i, t in rows]), bench, window, block_items=block_items))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items, window)


def test_codes_of_a_large_vocabulary():
    ids = np.array([(1 << 21) + 5, 3, 1 << 21, 1 << 22, 7, 0, 1 << 30], np.int32)
    assert (shingle_codes(ids, 3) > 0).tolist() == [True, True, True, False, False]
    assert (shingle_codes(np.array([1 << 21, 1 << 21, 1 << 21], np.int32), 3) > 0).all()


def test_large_vocabulary_keeps_its_windows():
    many = (1 << 21) + 9
    last = " ".join(f"w{i}" for i in range(many - 13, many))
    windows = item_windows([(1, " ".join(f"w{i}" for i in range(many - 13))), (2, last)], window=many)
    codes = {3: {c: 1 for c in _own_codes(list(windows.each())[1]).tolist()}}
    assert 0 not in codes[3] and min(codes[3]) > 0
    short = windows._replace(flat=windows.flat[windows.first[1] :], first=np.array([0, 13]), items=[[0]], names=["2"])
    ((n, at, found),) = match_texts([f"x {last} y".encode()], short, prefixes(short, codes))
    assert (n, at.tolist(), found) == (15, list(range(1, 14)), [0])


def test_items_without_an_id_and_blocks_of_bytes(spark):
    d = docs(spark, [(1, "a b c d e", None, None), (2, "k l m", None, None)])
    bench = spark.createDataFrame([(None, "b c d"), (4, "k l m"), (5, "q r s")], "item_id long, text string")
    for size in (1 << 20, 6):
        got = find_overlap(d, bench, 3, block_bytes=size, nameless=True)
        rows = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in contamination(got).collect()}
        assert rows == {1: (3, 0, True), 2: (3, 1, True)}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(find_overlap(empty(spark), bench)).count() == 0
    got = contamination(find_overlap(docs(spark, edge_rows()), bench)).collect()
    assert len(got) == len(edge_rows()) and not any(r["contaminated"] for r in got)


def test_query(spark, sf):
    d, b = (catalog.table(spark, sf, n) for n in ("documents", "benchmark"))
    got = catalog.QUERIES["op8_prefix_containment"](spark, sf)
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    want = brute(rows, [(r["item_id"], r["text"]) for r in b.collect()], 13)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and any(w[5] for w in want)
