"""F-tests, selection, stability and importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import report as R
from ..operators.attribution import linear_attribution as attribute
from ..operators.columns import keep_features
from ..operators.columns import select_columns as take_columns
from ..operators.folds import assign_folds
from ..operators.select import anova_f as f_table
from ..operators.select import double_k_best as two_filters
from ..operators.select import by_rules, k_rule
from ..operators.select import select_k_best as best
from ..operators.shape import explode_features, unpivot_features

from ..plans.univariate import fold_feature_scores, fold_feature_table
from ..session import durable
from .registry import LINE_FEATURES, WIDE_SQL, query, r6, rounded, table, wide, wide_long


def f_sql(source: str, keys: str) -> str:
    """CTE 'ftab' with F per key from rows (keys..., label, value)."""
    return f"""
      per as (select {keys}, label, count(value) as n, avg(value) as m, var_pop(value) * count(value) as m2 from {source} group by {keys}, label),
      pooled as (select *, sum(n * m) over (partition by {keys}) / sum(n) over (partition by {keys}) as g from per),
      ftab as (select {keys}, (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(m2) / (sum(n) - count(*))) as f,
                      any_value(g) as mean, sqrt(sum(m2 + n * pow(m - g, 2)) / sum(n)) as sd,
                      case when max(case when label = 1 then m end) >= max(case when label = 0 then m end) then 1.0::double else -1.0::double end as direction
               from pooled group by {keys})"""


@query(f"with {WIDE_SQL}, {f_sql('long', 'feature')} select feature, round(f, 6) as f from ftab")
def anova_f(spark, sf):
    return rounded(f_table(wide_long(spark, sf)), "f")


_LINE_UNION = " union all ".join(
    f"select '{c}' as feature, case when l_returnflag = 'R' then 1 else 0 end as label, {c} as value from lineitem" for c in LINE_FEATURES
)


@query(f"with long as ({_LINE_UNION}), {f_sql('long', 'feature')} select feature, round(f, 5) as f from ftab")
def anova_f_tall(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("label", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return f_table(unpivot_features(li, ["label"], LINE_FEATURES)).select("feature", (F.round("f", 5) + F.lit(0.0)).alias("f"))


@query(
    f"""with {WIDE_SQL}, {f_sql('long', 'feature')},
        r as (select feature, f, row_number() over (order by f desc, feature desc) as rank from ftab)
        select feature, round(f, 6) as f, cast(rank as integer) as rank from r where rank <= 20"""
)
def select_k_best(spark, sf):
    """k by the default rule for 64 features."""
    return rounded(best(f_table(wide_long(spark, sf)), k_rule(64)), "f")


@query(
    f"""with {WIDE_SQL}, {f_sql('long', 'feature')},
        r as (select feature, f, row_number() over (order by f desc, feature desc) as rank, count(*) over () as p from ftab),
        k as (select unnest(['default', 'at_most_50', 'at_most_200', 'tenth', 'fifth']) as rule)
        select rule, feature, round(f, 6) as f, cast(rank as integer) as rank from r join k
          on rank <= case rule when 'default' then greatest(5, least(greatest(20, p // 20), 100, p)) when 'at_most_50' then least(50, p)
            when 'at_most_200' then least(200, p) when 'tenth' then greatest(1, p // 10) else greatest(1, p // 5) end"""
)
def select_by_rules(spark, sf):
    """What each rule for the number of features keeps."""
    return rounded(by_rules(f_table(wide_long(spark, sf)), 64), "f")


@query(
    f"""with {WIDE_SQL}, {f_sql('long', 'feature')},
        r as (select feature, f, row_number() over (order by f desc, feature desc) as rank from ftab)
        select feature, round(f, 6) as f, cast(rank as integer) as rank from r where rank <= 10"""
)
def double_k_best(spark, sf):
    return rounded(two_filters(f_table(wide_long(spark, sf)), 50), "f")


@query(
    f"""with {WIDE_SQL}, {f_sql('long', 'feature')},
        keep as (select feature from ftab order by f desc, feature desc limit 10)
        select vec_id, count(*) as n, round(sum(value), 6) as total from long where feature in (select feature from keep) group by vec_id"""
)
def select_by_support(spark, sf):
    """The long form cut to the chosen features by a semi join."""
    long = wide_long(spark, sf)
    chosen = best(f_table(long), 10).select("feature", F.lit(True).alias("kept"))
    return keep_features(long, chosen).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("select l_orderkey, l_partkey, l_quantity, l_tax, l_discount from lineitem")
def select_columns(spark, sf):
    """The wide form cut to the features whose largest value is below 100."""
    li = table(spark, sf, "lineitem")
    profile = unpivot_features(li, [], LINE_FEATURES).groupBy("feature").agg(F.max("value").alias("top"))
    names = profile.filter(F.col("top") < 100).select("feature")
    return take_columns(li, ["l_orderkey", "l_partkey"], names)


FOLD_LONG_SQL = WIDE_SQL + """,
plan as (select vec_id, cast(repeat as integer) as repeat,
                cast((row_number() over (partition by repeat order by label, md5(concat('42-', repeat, ':', vec_id)), vec_id) - 1) % 5 as integer) as fold
         from wide, (select unnest(range({repeats})) as repeat)),
tagged as (select long.*, repeat, fold from long join plan using (vec_id)),
train as (select vec_id, label, feature, value, repeat, cast(f as integer) as fold from tagged, (select unnest(range(5)) as f) where tagged.fold <> f)"""

FOLD_TOP_SQL = f"""{f_sql('train', 'repeat, fold, feature')},
chosen as (select * from (select *, row_number() over (partition by repeat, fold order by f desc, feature desc) as rank from ftab) where rank <= 10)"""


def _tagged(spark, sf, repeats=1):
    # Read by the statistics and by the scoring: written once.
    rows = durable(assign_folds(wide(spark, sf), "vec_id", k=5, repeats=repeats, seed=42))
    return explode_features(rows, ["vec_id", "label", "repeat", "fold"], "embedding")


@query(
    f"""with {FOLD_LONG_SQL.format(repeats=3)}, {FOLD_TOP_SQL}
        select repeat, fold, feature, round(f, 6) as f, cast(rank as integer) as rank from chosen"""
)
def k_best_per_fold(spark, sf):
    """Training-fold F of 15 folds from one pass over the rows of each repeat."""
    t = fold_feature_table(_tagged(spark, sf, 3), 5)
    return rounded(best(t, 10, ["repeat", "fold"]).select("repeat", "fold", "feature", "f", "rank"), "f")


AUC_SQL = """
oof as (select t.repeat, t.fold, t.vec_id, t.label, avg(direction * (value - mean) / sd) as prob
        from tagged t join chosen c on t.repeat = c.repeat and t.fold = c.fold and t.feature = c.feature group by t.repeat, t.fold, t.vec_id, t.label),
ranked as (select *, rank() over (partition by repeat, fold order by prob) + (count(*) over (partition by repeat, fold, prob) - 1) / 2 as rk from oof),
aucs as (select repeat, fold, (sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) as roc_auc
         from ranked group by repeat, fold)"""


def _fold_auc(spark, sf, repeats=1):
    oof = durable(fold_feature_scores(_tagged(spark, sf, repeats), "vec_id", 5, 10))
    by = ["repeat", "fold"]
    return M.roc_auc(M.score_points(oof, by), by)


@query(f"with {FOLD_LONG_SQL.format(repeats=1)}, {FOLD_TOP_SQL}, {AUC_SQL} select repeat, fold, round(roc_auc, 6) as roc_auc from aucs")
def fold_feature_auc(spark, sf):
    """Flagship: choose, scale and sign features on training rows, score test rows, AUC per fold."""
    return rounded(_fold_auc(spark, sf), "roc_auc")


@query(
    f"""with {FOLD_LONG_SQL.format(repeats=3)}, {FOLD_TOP_SQL}
        select feature, count(*) as selection_count, round(count(*) / 15, 6) as selection_frequency from chosen group by feature"""
)
def feature_stability(spark, sf):
    chosen = best(fold_feature_table(_tagged(spark, sf, 3), 5), 10, ["repeat", "fold"])
    return rounded(R.order_stability(R.feature_stability(chosen, 15)), "selection_frequency")


@query(
    f"""with {FOLD_LONG_SQL.format(repeats=1)}, {f_sql('train', 'repeat, fold, feature')},
        r as (select fold, feature, f, row_number() over (partition by fold order by f desc, feature) as rank from ftab)
        select fold, feature, round(f, 6) as importance, cast(rank as integer) as rank from r where rank <= 15"""
)
def top_k_features(spark, sf):
    """The 15 leading features of each fold, ties by name."""
    t = fold_feature_table(_tagged(spark, sf), 5).select("fold", "feature", F.col("f").alias("importance"))
    return rounded(R.top_features(t, 15, ["fold"]), "importance")


@query(
    f"""with {WIDE_SQL}, coef as (select feature, avg(case when label = 1 then value end) - avg(case when label = 0 then value end) as coefficient,
                 avg(value) as mean from long group by feature)
        select l.feature, round(avg(abs(coefficient * (value - mean))), 6) as importance
        from long l join coef c on l.feature = c.feature group by l.feature"""
)
def linear_attribution(spark, sf):
    """Coefficients of the mean-difference direction."""
    long = wide_long(spark, sf)
    coef = long.groupBy("feature").agg(
        (F.avg(F.when(F.col("label") == 1, F.col("value"))) - F.avg(F.when(F.col("label") == 0, F.col("value")))).alias("coefficient")
    )
    return rounded(attribute(long, coef), "importance")
