import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from check_parity import compare, connect
from cohortsmith.llm import catalog
from cohortsmith.llm import divergence as D

from .edges import docs, edge_rows, empty, sentence


def brute(rows, least=10, top=10):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        n[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, c in df[lang].items() if c >= least]
        of = {s: n[lang, s] for x, s in groups if x == lang}
        whole = Counter()
        for c in of.values():
            whole.update(c)

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = share(of[source]), share(whole)
        pair = [(sum(f(p[t], r[t]) for t in kept), s.encode()) for s in of if s != source for r in [share(of[s])]]
        term = [(f(p[t], q[t]), t.encode()) for t in kept if of[source][t] and p[t] > q[t]]
        for part, found in (("pair", pair), ("term", term)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1])), 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item.decode(), value, rank))
    return sorted(out)


def table_rows():
    rng = random.Random(8)
    rows = []
    for i in range(160):
        text = sentence(rng, 30) + (" Only-A word" if i % 3 == 0 else " Ünder ÉCOLE 12x'y") + " ퟿\u0085 z"
        rows.append((i, text, ["en", "de", None][i % 3 if i % 7 else 0], f"s{i % 5}" if i % 11 else None))
    rows += [(900, "rare tongue", "xx", "a"), (901, None, "xx", "b"), (902, "alone", "yy", "a"), (903, "", "en", "empty")]
    return rows + edge_rows() + [(904, "repeat " * 200_000, "en", "s1")]


@pytest.mark.parametrize("tile, cells, held", [(64, 1 << 21, 200_000), (2, 40, 50)])
def test_against_brute_force(spark, monkeypatch, tile, cells, held):
    monkeypatch.setattr(D, "TILE", tile)
    monkeypatch.setattr(D, "CELLS", cells)
    monkeypatch.setattr(D, "HELD", held)
    rows = table_rows()
    got = sorted(map(tuple, D.audit_sources(docs(spark, rows)).collect()))
    assert got == brute(rows)


def test_low_bar_and_short_list(spark):
    rows = table_rows()[:40]
    got = sorted(map(tuple, D.audit_sources(docs(spark, rows), least_documents=1, top=3).collect()))
    assert got == brute(rows, 1, 3)


def test_counts_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9_000_000_000_000, 10**13, 5)], "n long, total long, kept long")
    got = rows.select(D._share(rows["n"]).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (9_000_000_000_000 + 2) // (10**13 + 10)


def test_words():
    assert D.words_of("Ab1cD É\u0085x'Y".encode()) == ["ab".encode(), b"cd", "É\u0085x".encode(), b"y"]
    assert np.frombuffer(D._WORDS, np.uint8).size == 256


def test_empty_table(spark):
    assert D.audit_sources(empty(spark)).count() == 0


def test_query_matches_sql(spark, sf):
    df = catalog.QUERIES["op12_source_divergence"](spark, sf)
    assert compare(df.toPandas(), connect(sf).execute(catalog.SQL["op12_source_divergence"]).df()) is None
