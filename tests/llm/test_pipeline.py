import random
from collections import Counter

import corpus_pipeline as P
from cohortsmith.llm import catalog
from cohortsmith.llm.contamination import WINDOW
from cohortsmith.session import durable

from .edges import docs, edge_rows, empty, sentence
from .test_contamination import brute as contaminated
from .test_ngram_join import brute as linked


def test_stages():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_records"]
    assert P.ORACLE_SQL is None


def test_each_stage_takes_effect(spark, sf):
    """Every stage against a plain version, on what the one before kept."""
    raw = catalog.table(spark, sf, "documents")
    text = {r["doc_id"]: r["text"] for r in raw.collect()}
    bench = [(r["item_id"], r["text"]) for r in catalog.table(spark, sf, "benchmark").collect()]
    clean = durable(P.toxicity(spark, raw, sf))
    ids = {r["doc_id"] for r in clean.collect()}
    scored = catalog.QUERIES["op7_cnn_toxicity"](spark, sf).collect()
    assert ids == {r["doc_id"] for r in scored if r["predicted"] == 0} and clean.columns == raw.columns
    single = durable(P.near_duplicates(spark, clean, sf))
    want = {i for i, _, c in linked([(i, text[i]) for i in ids]) if i == c}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == raw.columns
    apart = durable(P.decontamination(spark, single, sf))
    want -= {r[0] for r in contaminated([(i, text[i]) for i in want], bench, WINDOW) if r[5]}
    assert {r["doc_id"] for r in apart.collect()} == want and apart.columns == raw.columns
    mixed = durable(P.mixing(spark, apart, sf))
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) == want and max(times.values()) <= 3 and mixed.columns == raw.columns
    out = P.token_records(spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in out) == times
    ordered = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted(times.elements())
    assert sum(r["n_tokens"] for r in out) == ordered[-1]["start"] + ordered[-1]["n_tokens"]


def test_rows_are_judged_by_their_own_text(spark, sf):
    """With ids that are null or repeated."""
    rng = random.Random(3)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(7, a), (None, a), (9, a), (None, b), (None, b), (7, c), (None, None), (None, None), (9, "alone")]
    got = P.near_duplicates(spark, docs(spark, [(i, t, "en", "a") for i, t in rows]), sf).collect()
    want = [(7, a), (None, b), (7, c), (None, None), (None, None), (9, "alone")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    bad = max((r["text"] for r in catalog.table(spark, sf, "benchmark").collect() if r["text"]), key=len)
    rows = [(1, bad), (1, a), (None, bad), (None, b), (2, bad)]
    got = P.decontamination(spark, docs(spark, [(i, t, "en", "a") for i, t in rows]), sf).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, a), (None, b)], key=str)


def test_edge_rows_and_empty_tables(spark, sf):
    for d in (docs(spark, edge_rows()), empty(spark)):
        for _, stage in P.STAGES[:-1]:
            before = d.columns
            d = durable(stage(spark, d, sf))
            assert d.columns == before
        P.STAGES[-1][1](spark, d, sf).collect()


def test_run_gives_the_stages_result(spark, sf):
    assert P.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_a_task_has_one_python_worker(spark, sf, monkeypatch):
    """Overlaps are written before the next Python step reads them."""
    taken, judge = [], P.contamination
    monkeypatch.setattr(P, "contamination", lambda overlap: taken.append(overlap) or judge(overlap))
    rows = [(1, sentence(random.Random(5), 40), "en", "a"), (None, None, "en", "a")]
    assert P.decontamination(spark, docs(spark, rows), sf).count() == 2
    plan = taken[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and len(taken[0].inputFiles()) > 0
