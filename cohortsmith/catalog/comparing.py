"""Fold summaries, leaderboards and table alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import metrics as M
from ..operators import report as R
from .registry import SCORES_SQL, event_scores, query, r6, rounded, table

# Fold records: cut counts of every (model, fold) of the event scores.
FOLDS_SQL = SCORES_SQL + """,
pred as (select *, case when prob >= 0.1::double then 1 else 0 end as predicted from scores),
counts as (select model, fold, count(case when label = 0 and predicted = 0 then 1 end) as tn, count(case when label = 0 and predicted = 1 then 1 end) as fp,
                  count(case when label = 1 and predicted = 0 then 1 end) as fn, count(case when label = 1 and predicted = 1 then 1 end) as tp
           from pred group by model, fold),
folds as (select *, (tp + tn) / (tn + fp + fn + tp) as accuracy,
                 case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision,
                 case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall,
                 case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1
          from counts)"""
METRICS = ["accuracy", "precision", "recall", "f1"]


def _folds(spark, sf):
    pred = event_scores(spark, sf).withColumn("predicted", (F.col("prob") >= 0.1).cast("int"))
    return M.with_rates(M.confusion(pred, ["model", "fold"]))


def _mean_sd(metrics, sd="sd", v="{m}"):
    return ", ".join(
        f"round(avg({v.format(m=m)}), 6) as {m}_mean, round(stddev_samp({v.format(m=m)}), 6) as {m}_{sd}" for m in metrics
    )


@query(f"with {FOLDS_SQL} select model, count(*) as folds, {_mean_sd(METRICS)} from folds group by model")
def summarize_folds(spark, sf):
    s = R.summarize_folds(_folds(spark, sf), ["model"], METRICS)
    return rounded(s, *[f"{m}_{x}" for m in METRICS for x in ("mean", "sd")])


_OK = "case when fold <> 1 then {m} end"


@query(
    f"""with {FOLDS_SQL} select model, count(*) as n_folds_total, count(case when fold <> 1 then 1 end) as n_folds_with_positives,
        {_mean_sd(['recall', 'f1'], 'std', _OK)} from folds group by model"""
)
def summarize_ok_folds(spark, sf):
    d = _folds(spark, sf).withColumn("note", F.when(F.col("fold") != 1, "ok").otherwise("no_positives_in_test"))
    s = R.summarize_ok_folds(d, ["model"], ["recall", "f1"])
    return rounded(s, *[f"{m}_{x}" for m in ("recall", "f1") for x in ("mean", "std")])


@query(f"with {FOLDS_SQL} select model, cast(fold % 2 as integer) as pre_pca, count(*) as folds, {_mean_sd(METRICS)} from folds group by model, fold % 2")
def summarize_combo(spark, sf):
    d = _folds(spark, sf).withColumn("pre_pca", F.col("fold") % 2)
    s = R.summarize_folds(d, ["model", "pre_pca"], METRICS)
    return rounded(s, *[f"{m}_{x}" for m in METRICS for x in ("mean", "sd")])


_LONG = " union all ".join(f"select model, '{m}' as metric, cast({m} as double) as value from folds" for m in METRICS)


@query(f"with {FOLDS_SQL} select model, metric, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from ({_LONG}) group by model, metric")
def metric_long(spark, sf):
    return rounded(R.metric_summary_long(_folds(spark, sf), ["model"], METRICS), "mean", "std")


@query(
    f"""with {FOLDS_SQL} select model, fold, tp, round(recall, 6) as recall, -1.0::double as f1 from folds where model = 'm0'
        union all select model, fold, cast(-1 as bigint), round(recall, 6), round(f1, 6) from folds where model <> 'm0'"""
)
def all_folds_long(spark, sf):
    """Records of two runs with different columns under each other."""
    d = _folds(spark, sf)
    a = d.filter("model = 'm0'").select("model", "fold", "tp", "recall")
    b = d.filter("model <> 'm0'").select("model", "fold", "recall", "f1")
    s = R.stack_folds([a, b])
    return s.select("model", "fold", F.coalesce("tp", F.lit(-1)).alias("tp"), r6("recall").alias("recall"), r6(F.coalesce("f1", F.lit(-1.0))).alias("f1"))


@query(f"with {FOLDS_SQL}, m as (select model, avg(f1) as f1 from folds group by model) select model, round(f1, 6) as f1 from m order by f1 desc, model limit 1")
def best_model(spark, sf):
    d = _folds(spark, sf).groupBy("model").agg(F.avg("f1").alias("f1"))
    d = d.withColumn("position", F.substring("model", 2, 1).cast("int"))
    return rounded(R.best_model(d, "f1"), "f1")


@query(f"with {FOLDS_SQL} select model, fold % 2 as variant, round(avg(recall), 6) as recall_mean from folds group by model, fold % 2 order by avg(recall) desc, model, variant limit 4")
def leaderboard(spark, sf):
    d = _folds(spark, sf).withColumn("variant", F.col("fold") % 2)
    return rounded(R.leaderboard(d, ["model", "variant"], "recall", 4), "recall_mean")


@query(f"with {FOLDS_SQL} select model, format('{{:.4f}} ± {{:.4f}}', avg(f1), stddev_samp(f1)) as f1 from folds group by model")
def format_mean_sd(spark, sf):
    s = R.summarize_folds(_folds(spark, sf), ["model"], ["f1"])
    return s.select("model", R.format_mean_sd(F.col("f1_mean"), F.col("f1_sd")).alias("f1"))


@query(
    """with a as (select c_custkey, row_number() over (order by c_custkey desc) as position from customer),
       b as (select o_orderkey, row_number() over (order by o_orderkey) as position from orders)
       select position, c_custkey, o_orderkey from a join b using (position)"""
)
def align_by_position(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (-F.col("c_custkey")).alias("key"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("okey"))
    return A.align_by_position(c, o, "key", "okey").select("position", "c_custkey", "o_orderkey")


@query("select o_orderkey, o_custkey, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def align_by_id(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return A.align_by_id(o, c, "o_custkey", "c_custkey").drop("c_custkey")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def unmatched_ids(spark, sf):
    """Documents that nobody labelled."""
    d = table(spark, sf, "documents").select("doc_id")
    return A.unmatched(d, table(spark, sf, "labels").withColumnRenamed("doc_id", "labelled"), "doc_id", "labelled")


@query(
    """with rows as (
         select 'CLINICAL' as source, c_mktsegment as model, c_acctbal as v, c_custkey as id from customer
         union all select 'BIOMARKERS', c_mktsegment, o_totalprice, o_custkey from orders join customer on o_custkey = c_custkey)
       select model, round(avg(case when source = 'BIOMARKERS' then v end), 4) as BIOMARKERS_mean_value,
              count(case when source = 'BIOMARKERS' then 1 end) as BIOMARKERS_samples,
              round(avg(case when source = 'CLINICAL' then v end), 4) as CLINICAL_mean_value,
              count(case when source = 'CLINICAL' then 1 end) as CLINICAL_samples
       from rows group by model"""
)
def compare_sources(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))

    def summary(d, v):
        return d.groupBy(F.col("c_mktsegment").alias("model")).agg(
            F.round(F.avg(v), 4).alias("mean_value"), F.count(F.lit(1)).alias("samples")
        )

    parts = {"CLINICAL": summary(c, "c_acctbal"), "BIOMARKERS": summary(o, "o_totalprice")}
    return A.compare_sources(parts, "model", ["mean_value", "samples"])


@query("select d.doc_id, lang from documents d where d.doc_id in (select doc_id from labels where quality is not null)")
def index_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return A.keep_labeled(d, table(spark, sf, "labels"), "doc_id", "quality")
