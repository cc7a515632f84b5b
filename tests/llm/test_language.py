import re
import zlib
from collections import Counter

import numpy as np

from cohortsmith.llm import catalog
from cohortsmith.llm.language import PROFILE, fit_profiles, gram_counts, identify, top_grams

from .edges import docs, edge_rows, empty


def brute(text):
    words = [w for w in re.split(r"[\W\d_]+", text.lower()) if w]
    out = Counter()
    for w in words:
        padded = " " + w + " "
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def name(gram):
    parts = [(int(gram) >> s) & ((1 << 21) - 1) for s in (42, 21, 0)]
    return "".join(" " if p == 0 else chr(p) for p in parts if p != (1 << 21) - 1)


def test_grams_of_words():
    texts = ["Ein Bär, 3 Äpfel -- und\nmehr", "", "123", "a", "x y"]
    for t, (grams, counts) in zip(texts, gram_counts(texts)):
        assert Counter({name(g): int(c) for g, c in zip(grams, counts)}) == +brute(t)


def test_same_result_as_plain_version(spark, sf):
    table = catalog.table(spark, sf, "documents")
    rows = table.toPandas()
    learn = rows[[zlib.crc32(str(i).encode()) % 4 != 2 for i in rows["doc_id"]]]
    ranks = {}
    for lang, g in learn.groupby("lang"):
        grams = [gram_counts([t])[0] for t in g["text"]]
        total = Counter()
        for a, c in grams:
            total.update(dict(zip(a.tolist(), c.tolist())))
        ranks[lang] = {k: i for i, (k, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:PROFILE])}
    got = catalog.QUERIES["op3_rank_profiles"](spark, sf).toPandas().set_index("doc_id")
    for r in rows.itertuples():
        mine = top_grams(*gram_counts([r.text])[0]).tolist()
        cost = {lang: np.mean([abs(i - k[g]) if g in k else PROFILE for i, g in enumerate(mine)]) / PROFILE for lang, k in ranks.items()}
        best = min(sorted(cost), key=cost.get)
        assert got.loc[r.doc_id, "lang_pred"] == best and abs(got.loc[r.doc_id, "score"] - (1 - cost[best])) < 1e-9
    held = got[got["held_out"]]
    assert (held["lang_pred"] == rows.set_index("doc_id").loc[held.index, "lang"]).mean() > 0.95


def test_edge_rows(spark):
    rows = edge_rows()
    d = docs(spark, rows)
    got = identify(d, fit_profiles(d)).collect()
    assert len(got) == len(rows)
    blank = [r for r in got if r["lang_pred"] == "und"]
    assert all(r["score"] == 0 for r in blank)
    assert len(blank) == sum(1 for _, t, _, _ in rows if not t or not any(c.isalpha() for c in t))
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in identify(d, fit_profiles(empty(spark))).collect()} == {"und"}
    assert identify(empty(spark), fit_profiles(d)).count() == 0
