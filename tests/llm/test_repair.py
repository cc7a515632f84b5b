import hashlib
import random
import re
import zlib

import pytest

from cohortsmith.llm import catalog
from cohortsmith.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, row string, block int, first string, kind string, state string, said string, sign string"
SHOWN = lambda x: " " if x is None else str(x)
SPACE = " \t\n\v\f\r"
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{SHOWN(conv)}:{SHOWN(turn)}".encode()) % 20
        role, text = SHOWN(role), SHOWN(text)
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if fault == 3 else 1)


def cheapest(own):
    """(cost, edits) by dynamic programming from the right over (rows done, last turn kept)."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {}
    for i in range(len(own), -1, -1):
        def go(state, i=i):
            options = []
            if i == len(own):
                return (0, "") if state in ("", "a") else (3, "I") if state == "u" else (6, "II")
            fault, initial = own[i]
            nxt = lambda q: best[i + 1, q]
            options.append((4 + nxt(state)[0], "D" + nxt(state)[1]))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if initial == "s" and state == "" or initial == follow[state]:
                    options.append((more + nxt(initial)[0], "K" + nxt(initial)[1]))
                q = follow[state]
                options.append((3 + more + nxt(q)[0], "R" + nxt(q)[1]))
            return min(options)

        plain = {q: go(q) for q in ("", "s", "u", "a")}
        for _ in range(4):  # insertions stay in place: repeat until nothing improves
            for q in plain:
                c, e = plain[follow[q]]
                plain[q] = min(plain[q], (c + 3, "I" + e))
        best.update({(i, q): v for q, v in plain.items()})
    return best[0, ""]


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=key)
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest([(f, r[2][:1]) for f, r in zip(faults, own)])
        lines, state, at = [], "", 0
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}
        for e in audit:
            if e != "I":
                role, text = own[at][2:]
                at += 1
            if e == "D":
                continue
            if e != "K":
                role, text = NAMES[follow[state]], text if e == "R" else ""
            state = role[0]
            lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest, lines))
    return sorted(out, key=str)


def planted():
    rng = random.Random(4)
    rows = []
    for conv in range(120):
        for turn in range(rng.choice([1, 2, 3, 4, 6, 8, 40, 70]) if conv % 9 == 0 else rng.randint(1, 9)):
            role = ["user", "assistant"][turn % 2] if rng.random() > 0.2 else rng.choice(["system", "user", "assistant", "uncle", "tool", "", None])
            text = rng.choice(["Yes.", "no", "Why?  ", " \t", "", None, f"turn {turn}.", f"É 𝒳 {turn}!"])
            rows.append((conv, turn if rng.random() > 0.05 else rng.choice([None, 0, 900]), role, text))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (None, 1, "assistant", "b."), (None, None, None, None)]
    rows += [(500, 0, "system", "x " * 600_000 + "."), (500, 1, "user", "\n" * 90_000), (501, 0, "system", "only."), (502, None, "user", "q?"), (502, None, "assistant", "a.")]
    return rows + rows[:3]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "s", "t", "u") for r in rows], SCHEMA)


@pytest.mark.parametrize("block, stretch", [(8_192, 32), (8_192, 3), (5, 2), (1, 1)])
def test_against_brute_force(spark, monkeypatch, block, stretch):
    monkeypatch.setattr(R, "STRETCH", stretch)
    rows = planted()
    got = R.audit_damaged(table(spark, rows), block=block).collect()
    assert sorted(map(tuple, got), key=str) == [r[:-1] for r in brute(rows)]


def test_repaired_rows(spark):
    rows = planted()
    got = {}
    for r in R.rewrite_conversations(R.damage(table(spark, rows))).orderBy("conv_id", "pos").collect():
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert got == {r[0]: r[-1] for r in brute(rows) if r[-1]}


def test_search_is_cheapest_and_first():
    rng = random.Random(9)
    fault = {**{c: "" for c in "suax"}, **{c: "truncated" for c in "SUAX"}, **{c: "blank" for c in "0123"}}
    for n in [*range(9), *range(30, 60, 5)]:
        for _ in range(40):
            signs = "".join(rng.choices("suaxSUAX0123", [2, 8, 8, 1, 1, 2, 2, 1, 1, 1, 1, 1], k=n))
            assert R.repair_signs(signs) == cheapest([(fault[c], R._CLASS[c]) for c in signs]), signs


def test_long_dialogue_in_blocks(spark):
    rng = random.Random(2)
    rows = [(7, t, ["user", "assistant"][t % 2] if rng.random() > 0.1 else "system", f"turn {t}" + "." * (rng.random() > 0.1)) for t in range(3_000)]
    got = R.audit_damaged(table(spark, rows), block=256).collect()
    assert [tuple(r) for r in got] == [brute(rows)[0][:-1]]


def test_all_dropped_and_empty_table(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    got = R.audit_damaged(table(spark, [(3, turn, "user", "gone.")])).collect()
    assert [tuple(r) for r in got] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert R.audit_damaged(table(spark, [])).count() == 0 and R.rewrite_conversations(table(spark, [])).count() == 0


def test_query_matches_brute_force(spark, sf):
    df = catalog.QUERIES["op11_dialogue_repair"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert sorted(map(tuple, df.collect()), key=str) == [r[:-1] for r in brute(rows)]
