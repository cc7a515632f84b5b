"""Chat formatting by perspective rotation: a dialogue of several parties, once for each of them.

In a participant's rendering its own turns are the assistant's, every other participant is a
named user, and the loss mask covers the assistant's texts with their closing sign alone.
Everything here is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_on
from .common import row_numbers

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a rendered part; a longer dialogue continues in the next part.
PART_TURNS = 32


def numbered_turns(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, pos, part, role, text. Turns are placed by (turn, role, text), nulls first; the
    numbers come from one global sort, so a dialogue of any length is never in one task."""
    rows = turns.select("conv_id", "turn", "role", "text")
    numbered, _ = row_numbers(rows, ["conv_id", "turn", "role", "text"])
    first = numbered.groupBy("conv_id").agg(F.min("row").alias("first_row"))
    at = F.col("row") - F.col("first_row")
    placed = join_on(numbered, first, ["conv_id"]).withColumn("pos", at)
    # The control sign cannot come from a text or a name.
    safe = {c: F.replace(F.coalesce(c, F.lit(d)), F.lit("<|"), F.lit("<\\|")) for c, d in (("role", "unknown"), ("text", ""))}
    return placed.select("conv_id", "pos", F.floor(F.col("pos") / part_turns).alias("part"), safe["role"].alias("role"), safe["text"].alias("text"))


def rotate_perspectives(turns: DataFrame, system_role: str = "system", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_own, rendered, mask: one row for every participant of a
    dialogue and every part of it.

    `mask` lists the character spans that carry loss, as start:end with commas between. The
    system role is no participant; its turns are rendered as system. A null role is the
    participant 'unknown', a null text is empty, null ids are one dialogue, repeated turns stay
    repeated. A dialogue without participants and an empty table give no rows. Other columns
    are not read.
    """
    placed = numbered_turns(turns, part_turns)
    speakers = placed.filter(F.col("role") != system_role).select("conv_id", F.col("role").alias("speaker")).distinct()
    parts = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    views = join_on(parts, speakers, ["conv_id"])

    def head(x):
        own = x["role"] == F.col("speaker")
        who = F.when(x["role"] == system_role, F.lit("system")).when(own, F.lit("assistant"))
        return F.concat(F.lit(OPEN), F.coalesce(who, F.concat(F.lit("user name="), x["role"])), F.lit("\n"))

    pieces = F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit(CLOSE)).alias("body"), (x["role"] == F.col("speaker")).alias("own")))

    def step(acc, x):
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.when(x["own"], F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    out = views.withColumn("pieces", pieces)
    return out.select(
        "conv_id",
        "speaker",
        "part",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda x: x["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("pieces", start, step)["spans"], ",").alias("mask"),
    )


def rotation_sql(part_turns: int = PART_TURNS) -> str:
    return f"""
with t as (
  select conv_id, row_number() over (
           partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1 as pos,
         replace(coalesce(role, 'unknown'), '<|', '<\\|') as role, replace(coalesce(text, ''), '<|', '<\\|') as text
  from conversations
),
s as (select distinct conv_id, role as speaker from t where role <> 'system'),
v as (
  select t.conv_id, s.speaker, t.pos, t.pos // {part_turns} as part, t.role = s.speaker as own,
         '{OPEN}' || case when t.role = 'system' then 'system' when t.role = s.speaker then 'assistant'
           else 'user name=' || t.role end || chr(10) as head,
         t.text || '{CLOSE}' as body
  from t join s on t.conv_id is not distinct from s.conv_id
),
w as (
  select *, sum(length(head) + length(body) + 1) over (
           partition by conv_id, speaker, part order by pos rows unbounded preceding) as upto from v
)
select conv_id, speaker, cast(part as bigint) as part, count(*) as n_turns,
       cast(count(*) filter (where own) as bigint) as n_own,
       string_agg(head || body || chr(10), '' order by pos) as rendered,
       coalesce(string_agg(cast(cast(upto - 1 - length(body) as bigint) as varchar) || ':' || cast(cast(upto - 1 as bigint) as varchar), ','
         order by pos) filter (where own), '') as mask
from w group by conv_id, speaker, part"""
