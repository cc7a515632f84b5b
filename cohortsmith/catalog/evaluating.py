"""Metrics, curves, thresholds and intervals over event scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import TAIL_COEFFICIENTS, TAIL_SCALE
from ..operators import metrics as M
from ..operators.metrics import brier as brier_score
from ..operators.metrics import classification_report as report
from ..operators.metrics import prob_distribution as distribution
from .registry import POINTS_SQL, SCORES_SQL, event_scores, query, r6, rounded, table

BY = ["model"]

COUNTS_SQL = """
counts as (
  select model, count(case when label = 0 and predicted = 0 then 1 end) as tn, count(case when label = 0 and predicted = 1 then 1 end) as fp,
         count(case when label = 1 and predicted = 0 then 1 end) as fn, count(case when label = 1 and predicted = 1 then 1 end) as tp
  from pred group by model),
rates as (
  select *, case when tp + fn = 0 then 0.0::double else tp / (tp + fn) end as recall,
         case when tn + fp = 0 then 0.0::double else tn / (tn + fp) end as tnr,
         case when tp + fp = 0 then 0.0::double else tp / (tp + fp) end as precision,
         case when 2 * tp + fp + fn = 0 then 0.0::double else 2 * tp / (2 * tp + fp + fn) end as f1,
         (tp + tn) / (tn + fp + fn + tp) as accuracy
  from counts),
shown as (
  select model, tn, fp, fn, tp, round(accuracy, 6) as accuracy,
         round((recall + tnr) / ((case when tp + fn > 0 then 1 else 0 end) + (case when tn + fp > 0 then 1 else 0 end)), 6) as balanced_accuracy,
         round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1
  from rates)"""
RATES = ["accuracy", "balanced_accuracy", "precision", "recall", "f1"]


def _points(spark, sf):
    return M.score_points(event_scores(spark, sf), BY)


def _predicted(spark, sf, cut=0.1):
    return event_scores(spark, sf).withColumn("predicted", (F.col("prob") >= cut).cast("int"))


PRED_SQL = SCORES_SQL + ", pred as (select *, case when prob >= 0.1::double then 1 else 0 end as predicted from scores)"


@query(f"with {PRED_SQL}, {COUNTS_SQL} select * from shown")
def confusion_metrics(spark, sf):
    return rounded(M.with_rates(M.confusion(_predicted(spark, sf), BY)), *RATES)


@query(
    f"""with {PRED_SQL},
        per as (select cast(k as varchar) as class, count(case when label = k and predicted = k then 1 end) as h,
                       count(case when predicted = k then 1 end) as q, count(case when label = k then 1 end) as support
                from pred, (select unnest([0, 1]) as k) group by k),
        m as (select class, h, support, case when q = 0 then 0.0::double else h / q end as precision,
                     case when support = 0 then 0.0::double else h / support end as recall,
                     case when q + support = 0 then 0.0::double else 2 * h / (q + support) end as f1 from per),
        u as (select class, precision, recall, f1, support from m
              union all select 'accuracy', sum(h) / sum(support), sum(h) / sum(support), sum(h) / sum(support), sum(support) from m
              union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from m
              union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                     sum(f1 * support) / sum(support), sum(support) from m)
        select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from u"""
)
def classification_report(spark, sf):
    return rounded(report(_predicted(spark, sf)), "precision", "recall", "f1")


@query(
    f"""with {POINTS_SQL}
        select model, coalesce(threshold, 2.0::double) as threshold, round(precision, 6) as precision, round(recall, 6) as recall from (
          select model, round(score, 6) as threshold, run_pos / (run_pos + run_neg) as precision, run_pos / tot_pos as recall from points
          union all select distinct model, cast(null as double), 1.0::double, 0.0::double from points)"""
)
def pr_curve(spark, sf):
    c = rounded(M.pr_curve(_points(spark, sf), BY), "threshold", "precision", "recall")
    return c.withColumn("threshold", F.coalesce("threshold", F.lit(2.0)))


@query(
    f"""with {POINTS_SQL} select model, round(sum(pos * (tot_neg - run_neg + neg / 2)) / any_value(tot_pos * tot_neg), 6) as roc_auc
        from points group by model"""
)
def roc_auc(spark, sf):
    return rounded(M.roc_auc(_points(spark, sf), BY), "roc_auc")


@query(
    f"""with {POINTS_SQL} select model, round(sum(pos * run_pos / (run_pos + run_neg)) / any_value(tot_pos), 6) as avg_precision
        from points group by model"""
)
def average_precision(spark, sf):
    return rounded(M.average_precision(_points(spark, sf), BY), "avg_precision")


@query(f"with {SCORES_SQL} select model, round(avg(pow(prob - label, 2)), 6) as brier from scores group by model")
def brier(spark, sf):
    return rounded(brier_score(event_scores(spark, sf), BY), "brier")


_POLY_SQL = "0.0::double"
for _c in reversed(TAIL_COEFFICIENTS):
    _POLY_SQL = f"(({_POLY_SQL} + {_c}::double) * t)"


@query(
    f"""with {POINTS_SQL},
        s as (select model, any_value(tot_pos) as n1, any_value(tot_neg) as n0,
                     sum(pos * ((tot_pos + tot_neg) - (run_pos + run_neg) + (pos + neg + 1) / 2)) as w from points group by model),
        z as (select model, (w - n1 * (n1 + n0 + 1) / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12) as z from s),
        t as (select model, z, 1.0::double / (1.0::double + {TAIL_SCALE}::double * abs(z)) as t from z),
        p as (select model, z, exp(-z * z / 2) * 0.3989422804014327::double * {_POLY_SQL} as upper from t)
        select model, round(z, 6) as z, round(case when z >= 0 then upper else 1 - upper end, 6) as p_greater from p"""
)
def rank_sum(spark, sf):
    return rounded(M.rank_sum_test(_points(spark, sf), BY), "z", "p_greater")


@query(
    f"""with {SCORES_SQL} select model, label, count(*) as n, round(avg(prob), 6) as prob_mean, round(stddev_pop(prob), 6) as prob_std
        from scores group by model, label"""
)
def prob_distribution(spark, sf):
    return rounded(distribution(event_scores(spark, sf), BY), "prob_mean", "prob_std")


@query(f"with {SCORES_SQL} select model, event_id, round(prob, 6) as prob from scores where label = 1")
def positive_probs(spark, sf):
    return rounded(M.positive_probs(event_scores(spark, sf), "event_id", BY), "prob")


CUT_SQL = POINTS_SQL + """,
cut as (
  select model, score, case when run_pos + run_neg = 0 then 0 else run_pos / (run_pos + run_neg) end as precision,
         case when tot_pos = 0 then 0 else run_pos / tot_pos end as recall,
         case when tot_pos + run_pos + run_neg = 0 then 0 else 2 * run_pos / (tot_pos + run_pos + run_neg) end as f1
  from points)"""


@query(
    f"""with {CUT_SQL}, b as (select *, row_number() over (partition by model order by f1 desc, score) as rn from cut)
        select model, round(score, 6) as threshold, round(f1, 6) as f1 from b where rn = 1"""
)
def threshold_max_f1(spark, sf):
    pts = M.score_points(M.clip_unit(event_scores(spark, sf)), BY)
    return rounded(M.threshold_max_f1(pts, BY), "threshold", "f1")


_RECALL_SQL = """
thr as (
  select model, score as threshold from (
    select *, row_number() over (partition by model order by recall desc, score) as rn from (
      select model, score, recall from cut where precision >= {p}::double
      union all select distinct model, 1.0::double, 0.0::double from cut)) where rn = 1)"""


@query(f"with {CUT_SQL}, {_RECALL_SQL.format(p=0.2)} select model, round(threshold, 6) as threshold from thr")
def threshold_recall_at_precision(spark, sf):
    return rounded(M.threshold_recall_at_precision(_points(spark, sf), 0.2, BY), "threshold")


@query(
    f"""with {CUT_SQL}, {_RECALL_SQL.format(p=0.21)},
        pred as (select s.*, case when prob >= threshold then 1 else 0 end as predicted from scores s join thr using (model)), {COUNTS_SQL}
        select * from shown"""
)
def apply_threshold(spark, sf):
    s = event_scores(spark, sf)
    thr = M.threshold_recall_at_precision(M.score_points(s, BY), 0.21, BY)
    return rounded(M.with_rates(M.confusion(M.apply_threshold(s, thr, BY), BY)), *RATES)


@query(
    f"""with {SCORES_SQL}, l as (select model, min(prob) as lo, max(prob) as hi from scores group by model)
        select event_id, round((prob - lo) / (hi - lo + 1e-12), 6) as scaled from scores join l using (model)"""
)
def score_minmax(spark, sf):
    s = M.score_minmax(event_scores(spark, sf), BY, "prob", "scaled")
    return rounded(s.select("event_id", "scaled"), "scaled")


@query(
    """with v as (select cast(user_id % 3 as integer) as grp, user_id, round(avg(value), 6) as v from events group by user_id),
       numbered as (select grp, v, row_number() over (partition by grp order by md5(concat('42:', user_id)), user_id) as i, count(*) over (partition by grp) as n from v),
       draws as (select grp, n, i as slot, b, cast('0x' || substr(md5(concat('42:', b, ':', i)), 1, 15) as bigint) % n + 1 as i
                 from numbered, (select unnest(range(2000)) as b)),
       means as (select d.grp, b, avg(v) as m from draws d join numbered x on d.grp = x.grp and d.i = x.i group by d.grp, b)
       select grp, round(avg(m), 6) as boot_mean, round(quantile_cont(m, 0.025::double), 6) as ci_low, round(quantile_cont(m, 0.975::double), 6) as ci_high
       from means group by grp"""
)
def bootstrap_ci(spark, sf):
    e = table(spark, sf, "events")
    v = e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    v = v.withColumn("grp", (F.col("user_id") % 3).cast("int"))
    return rounded(M.bootstrap_ci(v, "user_id", "v", ["grp"]), "boot_mean", "ci_low", "ci_high")


_STEPS = " + ".join(f"cast(u >= {t} as integer)" for t in M.POISSON_STEPS)


@query(
    f"""with v as (select user_id, round(avg(value), 6) as v, cast(user_id % 3 as integer) as grp from events group by user_id),
       h as (select grp, v, blk, md5(concat_ws(':', '42', user_id, blk)) as h from v, (select unnest(range(100)) as blk)),
       x as (select grp, v, blk, i, cast('0x' || substr(h, 8 * i + 1, 8) as bigint) as u from h, (select unnest(range(4)) as i)),
       w as (select grp, blk, i, v, {_STEPS} as w from x),
       m as (select grp, blk, i, sum(w * v) / sum(w) as m from w group by grp, blk, i having sum(w) > 0)
       select grp, round(avg(m), 6) as boot_mean, round(quantile_cont(m, 0.025::double), 6) as ci_low, round(quantile_cont(m, 0.975::double), 6) as ci_high
       from m group by grp"""
)
def poisson_bootstrap(spark, sf):
    """Intervals of the mean by hashed Poisson weights: no row is numbered or joined."""
    e = table(spark, sf, "events")
    v = e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("v")).withColumn("grp", (F.col("user_id") % 3).cast("int"))
    return rounded(M.poisson_bootstrap_ci(v, "user_id", "v", ["grp"], draws=400), "boot_mean", "ci_low", "ci_high")


@query(
    f"""with {SCORES_SQL}, f as (select *, case when fold = 0 then null else prob end as p from scores)
        select fold, count(*) as n, count(*) - count(p) as n_failed, round(avg(coalesce(p, 0.5::double)), 6) as mean_prob from f group by fold"""
)
def uninformative_fallback(spark, sf):
    """Rows of a fold without a model score 0.5 and are counted."""
    from ..operators.tuning import fill_uninformative

    s = event_scores(spark, sf).withColumn("prob", F.when(F.col("fold") > 0, F.col("prob")))
    d = fill_uninformative(s)
    return d.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("failed"), 1)).alias("n_failed"), r6(F.avg("prob")).alias("mean_prob")
    )
