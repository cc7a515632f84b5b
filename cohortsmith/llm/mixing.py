"""Mixing sources to target weights by temperature.

Token shares are raised to an exponent between 0 (all sources alike) and 1 (as they are), which
is bisected until the mixture meets a target: an entropy, or a limit on repetition. The weights
are then realised as block permutations: a source is gone through in whole passes, each in its
own pseudo-random order, and the last pass ends where the source's token budget does.
Everything here is a DataFrame expression; the driver sees a few sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable

#: Halvings of the exponent's interval.
STEPS = 24
#: Rows that one slice of a pass should hold about.
SLICE_ROWS = 50_000


def count_tokens(text: str = "text") -> Column:
    """Pieces between blanks and line ends; a null or empty text has none."""
    t = F.col(f"`{text}`")
    gaps = F.length(t) - F.length(F.translate(t, " \n", ""))
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(gaps + 1).cast("long")


def source_key() -> Column:
    """A row's source; a null one counts as ''."""
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def draw_key(seed, source: Column, block: Column, tokens: Column) -> Column:
    """Place of a document in one pass over its source; rows with one id are told apart by
    their tokens."""
    parts = [F.lit(str(seed)), source, block.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))]
    return F.concat(F.md5(F.concat_ws(":", *parts)), F.lit(":"), F.lpad(tokens.cast("string"), 12, "0"))


class Target(NamedTuple):
    """Entropy as a share of the highest possible, or the most passes over any source."""

    entropy: float | None = None
    repeats: float | None = None


def fit_exponent(sizes: DataFrame, target: Target, budget: float | None) -> float:
    """Entropy: the largest exponent whose mixture has at least that entropy. Repeats: the
    smallest whose most repeated source stays within the limit. `sizes` has source_key, tokens."""
    p = F.col("tokens") / F.lit(sizes.agg(F.sum("tokens")).first()[0]).cast("double")
    shares = durable(sizes.select(p.alias("p")))
    n, total = shares.count(), float(sizes.agg(F.sum("tokens")).first()[0])

    def meets(a: float) -> bool:
        z, zl, most, least = shares.agg(
            F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")), F.max(F.pow("p", F.lit(a - 1))), F.min(F.pow("p", F.lit(a - 1)))
        ).first()
        if target.entropy is not None:
            return math.log(z) - a * zl / z >= target.entropy * math.log(n)
        return (most / least if budget is None else most / z * budget / total) <= target.repeats

    keep_low = target.entropy is not None
    if meets(1.0) if keep_low else meets(0.0):
        return 1.0 if keep_low else 0.0
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        if meets(mid) == keep_low:
            lo = mid
        else:
            hi = mid
    return lo if keep_low else hi


def plan_mixture(docs: DataFrame, target: Target, budget_share: float | None = 1.0, seed=0) -> DataFrame:
    """One row a source: source_key, tokens, weight, target_tokens, blocks (whole passes), and the
    slice and key at which the last pass is cut.

    The budget is `budget_share` times all tokens; with None it is the least at which no
    source loses a document. A source without tokens gets one whole pass and no weight.
    """
    rows = durable(docs.select(source_key().alias("source_key"), F.col("doc_id"), count_tokens().alias("tokens")))
    by_source = durable(rows.groupBy("source_key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    sizes = by_source.filter("tokens > 0")
    total, most = sizes.agg(F.sum("tokens"), F.max("rows")).first()
    if not total:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("weight", "double"), ("cut_slice", "string"), ("cut_key", "string"))]
        return by_source.select("source_key", "tokens", none[0], F.col("tokens").alias("target_tokens"), F.lit(1).cast("long").alias("blocks"), *none[1:])
    budget = None if budget_share is None else budget_share * total
    a = F.lit(fit_exponent(sizes, target, budget))
    share = F.col("tokens") / F.lit(float(total))
    power = F.pow(share, a)
    z, least = sizes.agg(F.sum(power), F.min(F.pow(share, a - 1))).first()
    budget = total * z / least if budget is None else budget
    weight = power / F.lit(z)
    whole = F.floor(F.round(weight * F.lit(float(budget)), 3)).cast("long")
    plan = sizes.select("source_key", "tokens", weight.alias("weight"), whole.alias("target_tokens"))
    plan = plan.withColumn("blocks", F.floor(F.col("target_tokens") / F.col("tokens")))
    plan = durable(plan.withColumn("rest", F.col("target_tokens") - F.col("blocks") * F.col("tokens")))
    digits = max(1, math.ceil(math.log(max(1, most / SLICE_ROWS), 16)))
    last = rows.join(plan.select("source_key", "blocks", "rest"), "source_key")
    last = last.select("source_key", "rest", "tokens", draw_key(seed, F.col("source_key"), F.col("blocks"), F.col("tokens")).alias("key"))
    last = durable(last.withColumn("slice", F.substring("key", 1, digits)))
    # Sums of slices first: only the slice that holds the end of the budget is put in order.
    slices = last.groupBy("source_key", "rest", "slice").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy("source_key").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = slices.withColumn("upto", upto).filter("upto > rest").withColumn("nth", F.row_number().over(W.partitionBy("source_key").orderBy("slice"))).filter("nth = 1")
    cut = durable(cut.select("source_key", "slice", (F.col("upto") - F.col("n")).alias("before")))
    inside = last.join(cut, ["source_key", "slice"])
    run = F.sum("tokens").over(W.partitionBy("source_key", "slice").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    taken = inside.withColumn("run", F.col("before") + run).filter("run <= rest").groupBy("source_key").agg(F.max("key").alias("cut_key"))
    plan = plan.join(cut.select("source_key", F.col("slice").alias("cut_slice")), "source_key", "left").join(taken, "source_key", "left")
    empty = by_source.filter("tokens = 0").select(
        "source_key", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("target_tokens"), F.lit(1).cast("long").alias("blocks"),
        F.lit(None).cast("string").alias("cut_slice"), F.lit(None).cast("string").alias("cut_key"),
    )
    return durable(plan.drop("rest").unionByName(empty))


def free_name(columns: Sequence[str], wanted: str) -> str:
    """The name wanted, with as many underscores behind it as make it new in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def realise(docs: DataFrame, plan: DataFrame, seed=0) -> DataFrame:
    """The documents with all their columns, once for each pass that takes them, and in
    __block and __key the pass and their place in it. No text is shuffled for it: a
    document's passes follow from its source's row in the plan.

    Null and empty texts have no tokens and come with every whole pass of their source; a null source
    is ''; repeated rows are drawn each by itself; an empty table gives no rows. Columns of the documents
    may have any names: if one is called __block or __key, the column added has underscores behind.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("doc"), F.col("doc_id"), source_key().alias("source"), count_tokens().alias("tokens"))
    rules = plan.select(F.col("source_key").alias("source"), F.struct("blocks", "cut_slice", "cut_key").alias("rule"))
    blocks, cut_slice = F.col("rule.blocks"), F.col("rule.cut_slice")
    passes = rows.join(rules, "source").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
    keyed = passes.withColumn("key", draw_key(seed, F.col("source"), F.col("block"), F.col("tokens")))
    before = F.expr("substring(key, 1, length(rule.cut_slice))")
    in_last = (before < cut_slice) | ((before == cut_slice) & (F.col("key") <= F.coalesce("rule.cut_key", F.lit(""))))
    kept = keyed.filter((F.col("block") < blocks) | F.coalesce(in_last, F.lit(False)))
    added = [F.col(c).alias(free_name(docs.columns, f"__{c}")) for c in ("block", "key")]
    return kept.select("doc.*", *added)


def mixture_sql(entropy: float, seed: int) -> str:
    """DuckDB twin of an entropy target with a budget of all tokens."""
    halvings = "".join(
        f"""b{i + 1} as (
  select case when h >= goal then m else lo end as lo, case when h >= goal then hi else m end as hi from (
    select any_value(lo) as lo, any_value(hi) as hi, any_value((lo + hi) / 2) as m, {entropy}::double * ln(count(*)) as goal,
           ln(sum(pow(p, (lo + hi) / 2))) - any_value((lo + hi) / 2) * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) as h
    from shares, b{i})),
"""
        for i in range(STEPS)
    )
    return f"""
with r as (
  select coalesce(source, '') as source_key, doc_id,
         cast(case when text is null or text = '' then 0
              else length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 end as bigint) as tokens
  from documents
),
sizes as (select source_key, cast(sum(tokens) as bigint) as tokens from r group by source_key),
total as (select cast(sum(tokens) as double) as total from sizes),
shares as (select source_key, tokens, tokens / total as p from sizes, total where tokens > 0),
untouched as (select -sum(p * ln(p)) >= {entropy}::double * ln(count(*)) as enough from shares),
b0 as (select 0.0::double as lo, 1.0::double as hi),
{halvings}
a as (select case when enough then 1.0::double else lo end as a from untouched, b{STEPS}),
z as (select sum(pow(p, a)) as z from shares, a),
plan as (
  select source_key, tokens, cast(floor(round(pow(p, a) / z * total, 3)) as bigint) as target from shares, a, z, total
  union all select source_key, tokens, 0 from sizes where tokens = 0
),
passes as (
  select source_key, tokens as all_tokens, case when tokens = 0 then 1 else target // tokens end as blocks,
         case when tokens = 0 then -1 else target - target // tokens * tokens end as rest
  from plan
),
draws as (
  select r.source_key, r.doc_id, r.tokens, cast(g.block as bigint) as block, p.blocks, p.rest,
         md5(concat_ws(':', '{seed}', r.source_key, cast(g.block as varchar), coalesce(cast(r.doc_id as varchar), '')))
           || ':' || lpad(cast(r.tokens as varchar), 12, '0') as place
  from r join passes p using (source_key), lateral (select unnest(range(p.blocks + 1)) as block) g
),
run as (
  select *, sum(tokens) over (partition by source_key, block order by place rows unbounded preceding) as upto from draws
)
select source_key, doc_id, tokens, block, place from run where block < blocks or upto <= rest"""
