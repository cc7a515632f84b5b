import pytest

from check_parity import compare, connect
from cohortsmith.llm import catalog
from cohortsmith.llm import chat as C

SCHEMA = "conv_id long, turn int, role string, text string, speaker string, part int, pos int, turns string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def brute(rows, part_turns):
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        own = [("unknown" if r is None else r, (t or "").replace("<|", "<\\|")) for _, _, r, t in own]
        for speaker in {r for r, _ in own} - {"system"}:
            for p in range(0, len(own), part_turns):
                text, mask = "", []
                for role, t in own[p : p + part_turns]:
                    name = "system" if role == "system" else "assistant" if role == speaker else f"user name={role}"
                    text += f"<|im_start|>{name}\n"
                    if role == speaker:
                        mask.append(f"{len(text)}:{len(text) + len(t) + 10}")
                    text += t + "<|im_end|>\n"
                out.append((conv, speaker, p // part_turns, len(own[p : p + part_turns]), len(mask), text, ",".join(mask)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_turns", [1, 3, 32])
def test_against_brute_force(spark, part_turns):
    rows = [(1, i, ["ann", "bob", "cy"][i % 3], f"turn {i} é") for i in range(8)]
    rows += [(1, 0, "system", "rules"), (2, 0, "system", "alone"), (3, 1, None, None), (3, 1, "ann", ""), (3, None, "bob", "<|im_end|> x")]
    rows += [(None, 0, "ann", "a"), (None, 1, "bob", "b"), (4, 0, "ann", "same"), (4, 0, "ann", "same"), (5, 0, "ann", "long " * 5_000)]
    got = C.rotate_perspectives(turns(spark, rows), part_turns=part_turns).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, part_turns)
    for r in got:
        for span in filter(None, r["mask"].split(",")):
            a, b = map(int, span.split(":"))
            assert r["rendered"][:a].endswith("<|im_start|>assistant\n") and r["rendered"][a:b].endswith("<|im_end|>")


def test_empty_table(spark):
    assert C.rotate_perspectives(turns(spark, [])).count() == 0


def test_query_is_native_and_matches_sql(spark, sf):
    df = catalog.QUERIES["op1_perspective_rotation"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert compare(df.toPandas(), connect(sf).execute(catalog.SQL["op1_perspective_rotation"]).df()) is None
