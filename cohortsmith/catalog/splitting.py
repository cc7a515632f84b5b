"""Hold-out, fold plans and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as S
from ..operators.report import fold_counts_by_class as role_counts
from ..operators.weights import balanced_weights as with_balanced_weights
from ..operators.weights import cost_weights as with_cost_weights
from ..operators.weights import safe_k as neighbours_allowed
from ..operators.weights import weight_table
from .registry import WIDE_SQL, query, r6, rounded, table, wide, wide_long

# events by type: 'error' is the positive class
ERRORS_SQL = "errors as (select event_id, cast(case when event_type = 'error' then 1 else 0 end as integer) as label from events)"


def _errors(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"))


def _holdout_sql(source: str, id_col: str, seed: int, tail: str) -> str:
    return f"""
      ranked as (select {id_col}, label, row_number() over (partition by label order by md5(concat('{seed}:', {id_col})), {id_col}) as rn,
                        count(*) over (partition by label) as c, count(*) over () as n from {source}),
      classes as (select distinct label, c, n, ceil(0.2::double * n - 1e-9) as target from ranked),
      shares as (select *, floor(target * c / n) as base, round(target * c / n - floor(target * c / n), 9) as frac from classes),
      quota as (select label, base + case when row_number() over (order by frac desc, label) <= target - sum(base) over () then 1 else 0 end as q from shares),
      split as (select {id_col}, label, case when rn <= q then 'test' else 'train' end as role from ranked join quota using (label))
      {tail}"""


@query(f"with {ERRORS_SQL}, {_holdout_sql('errors', 'event_id', 42, 'select event_id, label, role from split')}")
def holdout(spark, sf):
    return S.assign_holdout(_errors(spark, sf), "event_id", seed=42)


@query(
    """with base as (select p_partkey, case when p_partkey = 0 then 'rare' else p_brand end as label from part),
       least as (select min(c) as least from (select count(*) as c from base group by label)),
       ranked as (select p_partkey, label, row_number() over (order by md5(concat('42:', p_partkey)), p_partkey) as rn, count(*) over () as n from base)
       select p_partkey, label, case when rn <= ceil(0.2::double * n - 1e-9) then 'test' else 'train' end as role
       from ranked, least where least < 2"""
)
def holdout_auto_stratify(spark, sf):
    """One class has a single row, so the classes are pooled."""
    p = table(spark, sf, "part")
    d = p.select("p_partkey", F.when(F.col("p_partkey") == 0, "rare").otherwise(F.col("p_brand")).alias("label"))
    return S.assign_holdout(d, "p_partkey", seed=42, stratify="auto")


@query(f"with {ERRORS_SQL}, {_holdout_sql('errors', 'event_id', 42, 'select role, label, count(*) as n from split group by role, label')}")
def fold_counts_by_class(spark, sf):
    return role_counts(S.assign_holdout(_errors(spark, sf), "event_id", seed=42))


def _plan_sql(source: str, id_col: str, k: int, repeats: int, seed: int) -> str:
    return f"""
      plan as (select {id_col}, label, cast(repeat as integer) as repeat,
                      cast((row_number() over (partition by repeat order by label, md5(concat('{seed}-', repeat, ':', {id_col})), {id_col}) - 1) % {k} as integer) as fold
               from {source}, (select unnest(range({repeats})) as repeat))"""


@query(f"with {ERRORS_SQL}, {_plan_sql('errors', 'event_id', 5, 1, 42)} select * from plan")
def kfold(spark, sf):
    return S.fold_plan(_errors(spark, sf), "event_id", k=5, seed=42)


@query(f"with {ERRORS_SQL}, {_plan_sql('errors', 'event_id', 5, 3, 42)} select * from plan")
def repeated_kfold(spark, sf):
    return S.fold_plan(_errors(spark, sf), "event_id", k=5, repeats=3, seed=42)


@query(
    f"""with {WIDE_SQL}, {_plan_sql('wide', 'vec_id', 5, 3, 42)},
        outer_train as (select vec_id, label, repeat, cast(f as integer) as fold from plan, (select unnest(range(5)) as f) where plan.fold <> f)
        select vec_id, label, repeat, fold,
               cast((row_number() over (partition by repeat, fold order by label, md5(concat('42-0-', repeat, '-', fold, ':', vec_id)), vec_id) - 1) % 3 as integer) as inner_fold
        from outer_train"""
)
def inner_folds(spark, sf):
    plan = S.fold_plan(wide(spark, sf), "vec_id", k=5, repeats=3, seed=42)
    return S.inner_folds(plan, "vec_id", 5, 3, seed=42)


@query(f"with {WIDE_SQL} select vec_id, label, cast(0 as integer) as repeat, vec_id as fold from wide")
def leave_one_out(spark, sf):
    return S.leave_one_out(wide(spark, sf), "vec_id")


@query(
    f"""with {WIDE_SQL}, s as (select feature, label as c, count(value) as n, sum(value) as s from long group by feature, label),
        g as (select l.vec_id, l.label, s.c, sum(pow(l.value - (s.s - case when l.label = s.c then l.value else 0 end)
                     / (s.n - case when l.label = s.c then 1 else 0 end), 2)) as d
              from long l join s on l.feature = s.feature group by l.vec_id, l.label, s.c)
        select vec_id, label, round(sum(case when c = 0 then d else -d end), 6) as score from g group by vec_id, label"""
)
def loo_centroid(spark, sf):
    return rounded(S.loo_centroid_scores(wide_long(spark, sf), "vec_id"), "score")


AUDIT_SQL = """
audit as (
  select repeat, fold, n - test_size as train_size, test_size, test_pos,
         case when tp <= n - tp then tp - test_pos else (n - tp) - (test_size - test_pos) end as n_minority_train
  from (select repeat, fold, count(*) as test_size, cast(sum(label) as bigint) as test_pos,
               cast(sum(count(*)) over (partition by repeat) as bigint) as n,
               cast(sum(sum(label)) over (partition by repeat) as bigint) as tp
        from plan group by repeat, fold))"""


@query(f"with {WIDE_SQL}, {_plan_sql('wide', 'vec_id', 5, 3, 42)}, {AUDIT_SQL} select * from audit")
def fold_audit(spark, sf):
    return S.fold_audit(S.fold_plan(wide(spark, sf), "vec_id", k=5, repeats=3, seed=42))


# parts of one brand and size are rare: some folds hold no positive
RARE_SQL = "rare as (select p_partkey, cast(case when p_brand = 'Brand#1' and p_size <= 3 then 1 else 0 end as integer) as label from part)"


def _rare(spark, sf):
    p = table(spark, sf, "part")
    hit = (F.col("p_brand") == "Brand#1") & (F.col("p_size") <= 3)
    return p.select("p_partkey", F.when(hit, 1).otherwise(0).alias("label"))


@query(
    f"""with {RARE_SQL}, {_plan_sql('rare', 'p_partkey', 10, 3, 42)}
        select repeat, fold, case when min(label) = max(label) then 'no_positives_in_test' else 'ok' end as note
        from plan group by repeat, fold"""
)
def fold_validity(spark, sf):
    return S.fold_validity(S.fold_plan(_rare(spark, sf), "p_partkey", k=10, repeats=3, seed=42))


@query(
    f"""with {RARE_SQL}, {_plan_sql('rare', 'p_partkey', 2, 3, 42)}, {AUDIT_SQL}
        select repeat, fold, n_minority_train,
               cast(case when n_minority_train >= 2 then least(3, n_minority_train - 1) else 0 end as integer) as max_k,
               n_minority_train >= 2 as resample from audit"""
)
def safe_k(spark, sf):
    audit = S.fold_audit(S.fold_plan(_rare(spark, sf), "p_partkey", k=2, repeats=3, seed=42))
    return neighbours_allowed(audit).select("repeat", "fold", "n_minority_train", "max_k", "resample")


@query(
    f"""with {WIDE_SQL}, c as (select label, count(*) as n from wide group by label),
        w as (select label, round(sum(n) over () / (2 * n), 6) as weight, n from c)
        select label, n, weight, n as n_rows, round(weight * n, 4) as total from w"""
)
def balanced_weights(spark, sf):
    """The class table, and the weights as they sit on the rows."""
    d = wide(spark, sf)
    rows = with_balanced_weights(d).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.round("weight", 6)), 4).alias("total")
    )
    return rows.join(rounded(weight_table(d), "weight"), "label")


@query(f"with {WIDE_SQL} select vec_id, label, case when label = 1 then 20.0::double else 1.0::double end as weight from wide")
def cost_weights(spark, sf):
    return with_cost_weights(wide(spark, sf), 20.0).select("vec_id", "label", "weight")
