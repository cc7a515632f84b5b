"""Conversation structure repair: the cheapest edits that make a dialogue of roles well formed.

A well formed dialogue is empty, or turns of user and assistant in pairs, with a system turn before
them if need be. Iterative-deepening A*: a depth-first search tries the edits in ASCII order (Delete,
Insert, Keep, Rerole) under a bound that grows to the least cost it missed; a table keeps the largest
budget that failed in each state; the first path accepted is the cheapest, and of those the first in
order. A row is one sign to the search. Dialogues are cut into blocks of signs, and blocks into
stretches that are searched between any two states, so that a dialogue of any length is searched
in many tasks; the sums of the stretches decide which of their paths are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import durable, join_on
from .common import map_batches, row_numbers, ship

BLANKS = "\\x20\\x09-\\x0D"
#: Rows of a block, which a task searches, and of a stretch, which one search takes.
BLOCK, STRETCH = 8_192, 32
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States by the last turn kept: none, system, user, assistant. Where a user or assistant turn leads.
STATES = 4
_NEXT = (2, 2, 3, 2)
#: After all rows: what must still be inserted, and its cost. After none or an assistant all is well.
TAILS = ("", "II", "I", "")
TAIL_COSTS = tuple(INSERT * len(t) for t in TAILS)
NEVER = 1 << 40
ROLES = {2: "user", 3: "assistant"}

#: A sign is a role's initial, or x for any other, in upper case if the row is truncated and as
#: _GONE has it if it must go: blank or a duplicate.
_GONE = {"s": "0", "u": "1", "a": "2", "x": "3"}
_CLASS = {**{c: c for c in "suax"}, **{c.upper(): c for c in "suax"}, **{g: c for c, g in _GONE.items()}}


def _kept(state: int, role: str) -> int:
    """State after a row kept in its role, -1 where it may not stand."""
    if role == "s":
        return 1 if state == 0 else -1
    if role == "u":
        return 2 if state != 2 else -1
    return 3 if role == "a" and state == 2 else -1


def _bounds(signs: str) -> list[int]:
    """For each position, a cost that no repair of the rows from there on can go below.

    Rows that must go cost a deletion, truncated and unknown ones their cheaper way out. Of two
    neighbours that may not follow each other one is edited or a turn comes between; neighbours
    are counted in disjoint pairs, the best choice of pairs from the right.
    """
    own, extra = [], []
    for i, c in enumerate(signs):
        gone, trunc, role = c in "0123", c in "SUAX", _CLASS[c]
        own.append(DELETE if gone else min(DELETE, TRUNCATED * trunc + REROLE * (role == "x")))
        after = signs[i + 1] if i + 1 < len(signs) else "0"
        if gone or after in "0123" or "x" in (role, _CLASS[after]) or role + _CLASS[after] in ("su", "ua", "au"):
            extra.append(0)
        else:
            extra.append(min(REROLE, INSERT, DELETE) if not trunc and after in "sua" else DELETE - TRUNCATED)
    fixed, pairs = [0] * (len(signs) + 1), [0] * (len(signs) + 2)
    for i in range(len(signs) - 1, -1, -1):
        fixed[i] = fixed[i + 1] + own[i]
        pairs[i] = max(pairs[i + 1], pairs[min(i + 2, len(signs))] + extra[i])
    return [f + p for f, p in zip(fixed, pairs)]


def search(signs: str, start: int, ends: tuple[int, ...]) -> tuple[int, str, int]:
    """(cost, edits, last state) of the cheapest edits of all rows from `start`, where ending in a
    state costs what `ends` says; of equal ones the first in ASCII order. One of the ends must be in reach."""
    n, least = len(signs), _bounds(signs)
    last = min(ends)
    failed: dict[tuple[int, int], int] = {}  # cost to go is above this
    bound = least[0] + last
    while True:
        missed = NEVER
        path: list[str] = []
        # A frame holds the state, the cost so far and the edit to try next: D, I, K, R.
        stack = [[0, start, 0, 0]]
        while stack:
            frame = stack[-1]
            i, state, cost, edit = frame
            if edit == 0:
                ahead = ends[state] if i == n else max(least[i] + last, failed.get((i, state), -1) + 1)
                if cost + ahead > bound:
                    missed = min(missed, cost + ahead)
                    stack.pop()
                    if path:
                        path.pop()
                    continue
                if i == n:
                    return cost + ends[state], "".join(path), state
            if edit == 4:
                failed[i, state] = max(failed.get((i, state), -1), bound - cost)
                stack.pop()
                if path:
                    path.pop()
                continue
            frame[3] += 1
            c = signs[i]
            stays = c not in "0123"
            more = TRUNCATED if c in "SUAX" else 0
            if edit == 0:
                path.append("D")
                stack.append([i + 1, state, cost + DELETE, 0])
            elif edit == 1:
                path.append("I")
                stack.append([i, _NEXT[state], cost + INSERT, 0])
            elif stays and edit == 2:
                to = _kept(state, _CLASS[c])
                if to >= 0:
                    path.append("K")
                    stack.append([i + 1, to, cost + more, 0])
            elif stays and edit == 3:
                path.append("R")
                stack.append([i + 1, _NEXT[state], cost + REROLE + more, 0])
        bound = missed


@lru_cache(1 << 16)
def _stretch(signs: str, start: int, end: int) -> tuple[int, str]:
    if end == 0 and start != 0 or end == 1 and start != 1 and (start != 0 or not {"s", "S"} & set(signs)):
        return NEVER, ""  # no turn leads back to these
    cost, edits, _ = search(signs, start, tuple(0 if s == end else NEVER for s in range(STATES)))
    return cost, edits


@lru_cache(1 << 16)
def repair_signs(signs: str) -> tuple[int, str]:
    """(cost, edits) of a dialogue of one stretch: one search, with what must follow the last row."""
    cost, edits, state = search(signs, 0, TAIL_COSTS)
    return cost, edits + TAILS[state]


Table = list[list[tuple[int, str]]]


def _joined(a: Table, b: Table) -> Table:
    """Best of two neighbouring stretches between any two states. Edits of as many rows are never
    a prefix of each other, so the first in order joins the first in order."""
    return [
        [min((a[p][m][0] + b[m][q][0], a[p][m][1] + b[m][q][1]) for m in range(STATES)) for q in range(STATES)]
        for p in range(STATES)
    ]


def block_table(signs: str) -> Table:
    """(cost, edits) of a block from any state to any state: neighbours are joined two by two."""
    tables = [[[_stretch(signs[i : i + STRETCH], p, q) for q in range(STATES)] for p in range(STATES)] for i in range(0, len(signs), STRETCH)]
    while len(tables) > 1:
        tables = [_joined(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def choose_states(costs: list[list[int]], places: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of a dialogue of many blocks, and the states between which each block's edits are taken.

    costs[k] has the 16 costs of block k; places[k] how its edits from a state to each state rank."""
    to_go = [list(TAIL_COSTS)]
    for c in reversed(costs):
        to_go.append([min(c[p * STATES + q] + to_go[-1][q] for q in range(STATES)) for p in range(STATES)])
    to_go.reverse()
    state, taken = 0, []
    for k, (c, r) in enumerate(zip(costs, places)):
        best = [q for q in range(STATES) if c[state * STATES + q] + to_go[k + 1][q] == to_go[k][state]]
        after = min(best, key=lambda q: r[state * STATES + q])
        taken.append((state, after))
        state = after
    return to_go[0][0], taken


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def signed_rows(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as (conv_id, row, turn, role, text) in the order of the dialogues, and one slim row each:
    conv_id, row, turn, blank, duplicate, truncated, sign.

    A dialogue's rows are placed by (turn, role, text), nulls first. The rows come from one global
    sort, so a dialogue of any length is spread; a text is compared by its digest.
    """
    rows, _ = row_numbers(turns.select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"])
    slim = rows.select(
        "conv_id",
        "row",
        "turn",
        F.struct("role", F.sha2("text", 256).alias("digest")).alias("said"),
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(f"[^{BLANKS}]")).alias("blank"),
        (~F.col("text").rlike(f"[.!?][{BLANKS}]*\\z")).alias("cut"),
    )
    slim = durable(slim.select("conv_id", "row", "turn", F.sha2(F.to_json("said"), 256).alias("said"), "initial", "blank", "cut"))
    # Only what is said twice is joined back.
    first = slim.groupBy("conv_id", "said").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    seen = join_on(slim, first, ["conv_id", "said"], "left").withColumn("seen", F.coalesce(F.col("row") > F.col("first"), F.lit(False)))
    duplicate = F.col("seen") & ~F.col("blank")
    truncated = F.col("cut") & ~F.col("blank") & ~F.col("seen")
    known = F.when(F.col("initial").isin(*"sua"), F.col("initial")).otherwise(F.lit("x"))
    gone = F.translate(known, "suax", "0123")
    sign = F.when(F.col("blank") | F.col("seen"), gone).when(truncated, F.upper(known)).otherwise(known)
    return rows, seen.select("conv_id", "row", "turn", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), sign.alias("sign"))


def conversation_facts(slim: DataFrame) -> DataFrame:
    """conv_id, first, n, gaps, blank, duplicate, truncated. Turns are counted before dialogues, so a
    long dialogue arrives in few rows."""
    by_turn = slim.groupBy("conv_id", "turn").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return by_turn.groupBy("conv_id").agg(
        F.min("first").alias("first"),
        F.sum("n").alias("n"),
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )


def plan_edits(slim: DataFrame, facts: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(conv_id, cost, illegal), one row a dialogue, and (conv_id, block, row, state, edits), one a
    block: where it starts, the state it starts in, and its edits. Both are written once."""
    placed = join_on(slim.select("conv_id", "row", "sign"), facts.select("conv_id", "first", "n"), ["conv_id"])
    placed = placed.withColumn("block", F.floor((F.col("row") - F.col("first")) / block).cast("int"))
    blocks = placed.groupBy("conv_id", "first", "n", "block").agg(F.sort_array(F.collect_list(F.struct("row", "sign"))).alias("signs"))
    blocks = blocks.select("conv_id", "block", "first", "n", F.array_join("signs.sign", "").alias("signs"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for first, n, k, signs in zip(d["first"], d["n"], d["block"], d["signs"]):
                roles = "".join(_CLASS[c] for c in signs)
                illegal = sum(not _legal(a, b) for a, b in zip(roles, roles[1:]))
                if n == len(signs) <= STRETCH:
                    cost, edits = repair_signs(signs)
                    found, places = [(cost, edits)], [0]
                else:
                    table = block_table(signs)
                    found = [table[p][q] for p in range(STATES) for q in range(STATES)]
                    # Edits from one state, in their order; those that cannot be come last.
                    places = [sum(o < e for o in sorted(x[1] for x in row)) if c < NEVER else STATES for row in table for c, e in row]
                out.append((first, k, signs[0], signs[-1], illegal, [c for c, _ in found], places, [e for _, e in found]))
            yield pd.DataFrame(out, columns=["first", "block", "head", "end", "illegal", "costs", "places", "edits"])

    schema = "first long, block int, head string, end string, illegal long, costs array<long>, places array<int>, edits array<string>"
    solved = durable(map_batches(blocks.select("first", "n", "block", "signs"), solve, schema))

    # A dialogue's blocks meet as some forty small numbers each.
    sums = solved.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("block", "head", "end", "illegal", "costs", "places"))).alias("blocks"))

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for first, parts in zip(d["first"], d["blocks"]):
                illegal = sum(p["illegal"] for p in parts)
                illegal += sum(not _legal(_CLASS[a["end"]], _CLASS[b["head"]]) for a, b in zip(parts, parts[1:]))
                costs = [[int(c) for c in p["costs"]] for p in parts]
                if len(costs[0]) == 1:
                    out.append((first, illegal, costs[0][0], [0], [0], [-1]))
                else:
                    cost, taken = choose_states(costs, [[int(x) for x in p["places"]] for p in parts])
                    at = [p * STATES + q for p, q in taken]
                    out.append((first, illegal, cost, at, [p for p, _ in taken], [q for _, q in taken]))
            yield pd.DataFrame(out, columns=["first", "illegal", "cost", "at", "state", "after"])

    schema = "first long, illegal long, cost long, at array<int>, state array<int>, after array<int>"
    chosen = durable(map_batches(sums, combine, schema))
    each = chosen.select("first", F.size("at").alias("blocks"), F.posexplode(F.arrays_zip("at", "state", "after")).alias("block", "x"))
    tail = F.when((F.col("block") + 1 == F.col("blocks")) & (F.col("x.after") >= 0), F.element_at(F.array(*map(F.lit, TAILS)), F.col("x.after") + 1)).otherwise(F.lit(""))
    picked = each.join(solved.select("first", "block", "edits"), ["first", "block"]).select(
        "first", "block", F.col("x.state").alias("state"), F.concat(F.col("edits")[F.col("x.at")], tail).alias("edits")
    )
    named = facts.select("conv_id", "first")
    edits = named.join(picked, "first").select("conv_id", "block", (F.col("first") + F.col("block").cast("long") * block).alias("row"), "state", "edits")
    return named.join(chosen.select("first", "cost", "illegal"), "first").drop("first"), durable(edits)


def replay(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that a block's edits make of its rows."""
    for e in edits:
        if e == "I":
            state = _NEXT[state]
            yield e, ROLES[state], ""
            continue
        role, text = next(rows)
        if e == "K":
            state = _kept(state, _CLASS.get(role[:1], "x"))
            yield e, role, text
        elif e == "R":
            state = _NEXT[state]
            yield e, ROLES[state], text


def _stream(rows: DataFrame, edits: DataFrame, emit: Callable, schema: T.StructType) -> DataFrame:
    """Runs through each dialogue in order: a block's edits come before its rows. A dialogue is in one
    task, which holds one batch at a time; its digest can be computed in no other way."""
    none = F.lit(None).cast("string")
    both = rows.select("conv_id", "row", F.lit(1).alias("kind"), F.lit(0).alias("block"), F.lit(0).alias("state"), none.alias("edits"), "role", "text").unionByName(
        edits.select("conv_id", "row", F.lit(0).alias("kind"), "block", "state", "edits", none.alias("role"), none.alias("text"))
    )
    dealt = both.repartition("conv_id").sortWithinPartitions("row", "kind")
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        yield from emit(records())

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def _dialogues(records: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, None) where a dialogue begins, then (conv_id, turn) for its repaired turns."""
    following = next(records, None)

    def own() -> Iterator[tuple[str, str]]:
        nonlocal following
        while following is not None and following[2] == 1:
            role, text = following[6], following[7]
            following = next(records, None)
            yield role, text

    while following is not None:
        conv, _, _, block, state, edits = following[:6]
        following = next(records, None)
        if block == 0:
            yield conv, None
        for turn in replay(edits, state, own()):
            yield conv, turn


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, pos, edit, role, text: the repaired dialogues turn by turn."""
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL("pos long, edit string, role string, text string").fields])
    kind = to_arrow_schema(schema)

    def emit(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, size, pos = [], 0, 0
        for conv, turn in _dialogues(records):
            if turn is None:
                pos = 0
                continue
            out.append((conv, pos, *turn))
            pos, size = pos + 1, size + len(turn[2])
            if len(out) == 1_000 or size > 1 << 22:
                yield _batch(out, kind)
                out, size = [], 0
        if out:
            yield _batch(out, kind)

    return _stream(rows, edits, emit, schema)


def repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: digest of the repaired dialogue, `role:text` a turn, line ends between."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    kind = to_arrow_schema(schema)

    def emit(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, turn in _dialogues(records):
            if turn is None:
                if len(out) == 4_096:
                    yield _batch([(c, d.hexdigest()) for c, d, _ in out], kind)
                    out = []
                out.append([conv, hashlib.sha256(), ""])
                continue
            now = out[-1]
            now[1].update(f"{now[2]}{turn[1]}:{turn[2]}".encode())
            now[2] = "\n"
        if out:
            yield _batch([(c, d.hexdigest()) for c, d, _ in out], kind)

    return _stream(rows, edits, emit, schema)


def filled(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, a missing role or text being one blank."""
    blank = F.lit(" ")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")])


def repair_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every
    dialogue: its missing turn numbers, its rows by first fault, neighbours whose roles may not
    follow each other, the least cost of a repair, its edits, and a digest of the outcome.

    turns: conv_id, turn, role, text; other columns are not read. Null ids are one dialogue, a null
    role or text is one blank, null turns come first, equal ones are ordered by role and text. Rows
    that repeat are duplicates. Texts of any length are read whole; an empty table gives no rows.
    """
    rows, slim = signed_rows(filled(turns))
    slim = durable(slim)
    facts = durable(conversation_facts(slim))
    costs, edits = plan_edits(slim, facts, block)
    audit = edits.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "edits")))["edits"], "").alias("audit"))
    out = join_on(join_on(facts.drop("first", "n"), costs, ["conv_id"]), audit, ["conv_id"])
    out = join_on(out, repaired_digests(rows, edits), ["conv_id"])
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rewrite_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired dialogues themselves: conv_id, pos, edit (I, K or R), role, text. Cases as in
    repair_conversations; a dialogue of which every row is deleted gives no rows."""
    rows, slim = signed_rows(filled(turns))
    slim = durable(slim)
    _, edits = plan_edits(slim, durable(conversation_facts(slim)), block)
    return repaired_turns(rows, edits)


def damage(turns: DataFrame) -> DataFrame:
    """A table of dialogues with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1
    empties its text, 2 takes its closing signs, 3 repeats it, 4 gives it to the user."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = filled(turns).withColumn("fault", fault).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, F.lit(2)).otherwise(F.lit(1))))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def audit_damaged(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """repair_conversations of the damaged table, with a row for every dialogue of the whole one:
    a dialogue of which no row is left has zeros, no edits and the digest of nothing."""
    found = repair_conversations(damage(turns), block)
    out = join_on(turns.select("conv_id").distinct(), found, ["conv_id"], "left")
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = hashlib.sha256().hexdigest()
    return out.withColumns({**zeros, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(nothing))})

