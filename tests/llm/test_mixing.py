import hashlib
import math
import random
from collections import Counter

import pytest

from check_parity import compare, connect
from cohortsmith.llm import catalog
from cohortsmith.llm import mixing as M

from .edges import docs, edge_rows, empty, sentence


def skewed(seed=3):
    """One source with most tokens, a small one, a tiny one, one without tokens."""
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randint(1, 40)), "en", "big") for i in range(120)]
    rows += [(200 + i, sentence(rng, rng.randint(1, 40)), "en", "mid") for i in range(25)]
    rows += [(300 + i, sentence(rng, 5), "en", None) for i in range(4)] + [(400, None, "en", "none"), (401, "", "en", "none")]
    return rows + [rows[0], (None, "a b c", "en", "big")]


def tokens(t):
    return t.count(" ") + t.count("\n") + 1 if t else 0


def shares(rows):
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s or ""] += tokens(t)
    return {s: n for s, n in sizes.items() if n}


def brute(rows, a, budget_share, seed):
    sizes = shares(rows)
    total = sum(sizes.values())
    power = {s: (n / total) ** a for s, n in sizes.items()}
    z = sum(power.values())
    budget = budget_share * total if budget_share else total * z / min(power[s] / (n / total) for s, n in sizes.items())
    want = Counter()
    for s in {r[3] or "" for r in rows}:
        own = [r for r in rows if (r[3] or "") == s]
        if s not in sizes:
            want.update((s, r[0], tokens(r[1]), 0) for r in own)
            continue
        target = math.floor(round(power[s] / z * budget, 3))
        for block in range(target // sizes[s] + 1):
            left = sizes[s] if block < target // sizes[s] else target % sizes[s]
            name = lambda r: "" if r[0] is None else str(r[0])  # noqa: B023,E731
            order = sorted(own, key=lambda r: (hashlib.md5(f"{seed}:{s}:{block}:{name(r)}".encode()).hexdigest(), tokens(r[1])))  # noqa: B023
            for r in order:
                left -= tokens(r[1])
                if left < 0:
                    break
                want[(s, r[0], tokens(r[1]), block)] += 1
    return want


def drawn(df):
    return Counter((r["source"] or "", r["doc_id"], tokens(r["text"]), r[df.columns[-2]]) for r in df.collect())


@pytest.mark.parametrize("target,budget", [(M.Target(entropy=0.9), 1.0), (M.Target(entropy=0.8), 2.5), (M.Target(repeats=3.0), None), (M.Target(repeats=2.0), 1.0)])
def test_against_brute_force(spark, target, budget):
    rows = skewed()
    d = docs(spark, rows)
    sizes = shares(rows)
    total = sum(sizes.values())
    a = M.fit_exponent(spark.createDataFrame(list(sizes.items()), "source_key string, tokens long"), target, None if budget is None else budget * total)
    power = {s: (n / total) ** a for s, n in sizes.items()}
    z = sum(power.values())
    entropy = -sum(p / z * math.log(p / z) for p in power.values()) / math.log(len(sizes))
    repeat = {s: power[s] / (n / total) for s, n in sizes.items()}
    most = max(repeat.values()) / (min(repeat.values()) if budget is None else z / budget)
    assert 0 < a < 1
    assert abs(entropy - target.entropy) < 1e-5 if target.entropy else abs(most - target.repeats) < 1e-4
    plan = M.plan_mixture(d, target, budget, seed=5)
    mixed = M.realise(d, plan, seed=5)
    assert mixed.columns[: len(d.columns)] == d.columns
    assert drawn(mixed) == brute(rows, a, budget, 5)
    if budget is None:  # no document is lost
        assert {r[1] for r in drawn(mixed)} == {r[0] for r in rows}


def test_edge_rows(spark):
    d = docs(spark, edge_rows())
    mixed = M.realise(d, M.plan_mixture(d, M.Target(repeats=2.0), None, seed=1), seed=1)
    assert {r[1] for r in drawn(mixed)} == {r[0] for r in edge_rows()}
    nothing = empty(spark)
    assert M.realise(nothing, M.plan_mixture(nothing, M.Target(entropy=0.9))).count() == 0
    blank = docs(spark, [(1, None, None, None), (2, "", "en", "a")])
    assert M.realise(blank, M.plan_mixture(blank, M.Target(entropy=0.9))).count() == 2


def test_query_is_native_and_matches_sql(spark, sf):
    df = catalog.QUERIES["op9_temperature_mixture"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert compare(df.toPandas(), connect(sf).execute(catalog.SQL["op9_temperature_mixture"]).df()) is None
