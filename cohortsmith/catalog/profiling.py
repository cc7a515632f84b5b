"""Column filters, imputation and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import clean_numeric
from ..operators import columns as K
from ..operators.folds import assign_folds, assign_holdout
from ..operators.impute import median_fill, median_table
from ..operators.impute import missing_report as missing
from ..operators.impute import train_medians
from ..operators.scale import apply_scale, scale_table, standardize, train_moments, train_scale_table
from ..operators.shape import explode_features, unpivot_features
from ..session import durable
from .registry import TALL_SQL, WIDE_SQL, query, r6, rounded, table, tall_long, wide, wide_long

PROFILE_SQL = TALL_SQL + """,
profile as (
  select feature, count(*) as n, count(value) as n_valid, count(distinct value) as n_distinct,
         var_pop(value) as variance
  from long group by feature
)"""

TEXT_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "half", "most"]


@query(
    """with texts as (
         select 'o_orderkey' as feature, cast(o_orderkey as varchar) as raw from orders
         union all select 'o_custkey', cast(o_custkey as varchar) from orders
         union all select 'o_orderstatus', o_orderstatus from orders
         union all select 'o_totalprice', cast(o_totalprice as varchar) from orders
         union all select 'o_orderpriority', o_orderpriority from orders
         union all select 'half', case when o_orderkey % 2 = 0 then 'NaN;' else '1' end from orders
         union all select 'most', case when o_orderkey % 3 = 0 then ' ' else '7.5' end from orders),
       rates as (
         select feature, count(case when regexp_matches(trim(raw), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
                                    then 1 end) / count(*) as rate
         from texts group by feature)
       select feature, round(rate, 6) as rate, rate > 0.5 as kept from rates"""
)
def numeric_rate_filter(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select(
        *TEXT_COLUMNS[:5],
        F.when(F.col("o_orderkey") % 2 == 0, "NaN;").otherwise("1").alias("half"),
        F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("7.5").alias("most"),
    )
    long = unpivot_features(d, [], TEXT_COLUMNS, cast="string")
    long = long.withColumn("value", clean_numeric(F.col("value")))
    return rounded(K.numeric_rate(K.profile_features(long)), "rate")


@query(f"with {PROFILE_SQL} select feature, n_valid, n_valid > 0 as kept from profile")
def all_null_filter(spark, sf):
    return K.not_all_null(K.profile_features(tall_long(spark, sf)))


@query(
    f"""with {PROFILE_SQL} select feature, n_valid > 0 and n_distinct + (case when n_valid < n then 1 else 0 end) > 1
        as kept from profile"""
)
def constant_filter(spark, sf):
    return K.not_constant(K.profile_features(tall_long(spark, sf)))


@query(f"with {PROFILE_SQL} select feature, n_distinct > 1 as kept from profile")
def zero_variance_filter(spark, sf):
    return K.not_zero_variance(K.profile_features(tall_long(spark, sf)))


@query(
    f"""with {PROFILE_SQL} select feature, round(log10(1 + coalesce(variance, 0)), 6) as log_variance,
          coalesce(variance, 0) > 0.01 as kept from profile"""
)
def variance_filter(spark, sf):
    """Reported on a log scale, where sums of any size agree to six digits."""
    d = K.variance_above(K.profile_features(tall_long(spark, sf)))
    return d.select("feature", r6(F.log10(1 + F.col("variance"))).alias("log_variance"), "kept")


@query(
    f"""with {PROFILE_SQL} select 'all_null' as filter, count(*) as features_in, count(case when n_valid > 0 then 1 end) as features_out from profile
        union all select 'zero_variance', count(*), count(case when n_distinct > 1 then 1 end) from profile
        union all select 'variance', count(*), count(case when coalesce(variance, 0) > 0.01 then 1 end) from profile"""
)
def filter_report(spark, sf):
    p = K.profile_features(tall_long(spark, sf))
    return K.filter_report(
        {"all_null": K.not_all_null(p), "zero_variance": K.not_zero_variance(p), "variance": K.variance_above(p)}
    )


@query(f"with {TALL_SQL} select feature, count(*) as n, count(*) - count(value) as n_missing from long group by feature")
def missing_report(spark, sf):
    return missing(tall_long(spark, sf))


@query(
    f"""with {TALL_SQL}, med as (select feature, median(value) as median from long group by feature)
        select l.feature, round(coalesce(any_value(m.median), 0.0::double), 6) as median, count(*) - count(value) as n_filled,
               round(avg(coalesce(value, m.median, 0.0::double)), 4) as mean_after
        from long l join med m on l.feature = m.feature group by l.feature"""
)
def median_impute_global(spark, sf):
    long = tall_long(spark, sf)
    meds = durable(median_table(long))
    filled = median_fill(long.withColumn("missing", F.col("value").isNull()), meds)
    after = filled.groupBy("feature").agg(
        F.count(F.when(F.col("missing"), 1)).alias("n_filled"), F.round(F.avg("value"), 4).alias("mean_after")
    )
    return after.join(meds, "feature", "left").select(
        "feature", r6(F.coalesce("median", F.lit(0.0))).alias("median"), "n_filled", "mean_after"
    )


def _event_cohort(spark, sf):
    """Two features with gaps, label 'error', and five folds."""
    e = table(spark, sf, "events")
    d = e.select(
        "event_id",
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.when(F.col("value") <= 100, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 4 > 0, F.get_json_object("props", "$.k").cast("double")).alias("k"),
    )
    tagged = durable(assign_folds(d, "event_id", k=5, seed=7))
    return unpivot_features(tagged, ["event_id", "repeat", "fold"], ["value", "k"])


EVENT_FOLDS_SQL = """
base as (
  select event_id, case when event_type = 'error' then 1 else 0 end as label,
         case when value <= 100 then value end as value,
         case when event_id % 4 > 0 then cast(json_extract_string(props, '$.k') as double) end as k
  from events),
tagged as (
  select *, cast((row_number() over (order by label, md5(concat('7-0:', event_id)), event_id) - 1) % 5 as integer) as fold
  from base),
long as (
  select event_id, fold, 'value' as feature, value from tagged
  union all select event_id, fold, 'k', k from tagged)"""


@query(
    f"""with {EVENT_FOLDS_SQL}, folds as (select unnest(range(5)) as f),
        med as (select cast(f as integer) as fold, feature, median(value) as median from long, folds where long.fold <> f group by f, feature)
        select m.fold, m.feature, round(any_value(m.median), 6) as median, count(*) - count(value) as n_filled,
               round(avg(coalesce(value, m.median)), 8) as test_mean
        from long l join med m on l.fold = m.fold and l.feature = m.feature group by m.fold, m.feature"""
)
def median_impute_train(spark, sf):
    """Medians of the training folds fill the test fold."""
    long = _event_cohort(spark, sf)
    meds = durable(train_medians(long, 5))
    filled = median_fill(long.withColumn("missing", F.col("value").isNull()), meds, ["repeat", "fold"])
    after = filled.groupBy("repeat", "fold", "feature").agg(
        F.count(F.when(F.col("missing"), 1)).alias("n_filled"), F.round(F.avg("value"), 8).alias("test_mean")
    )
    return after.join(meds, ["repeat", "fold", "feature"]).select("fold", "feature", r6("median").alias("median"), "n_filled", "test_mean")


@query(
    f"""with {WIDE_SQL}, t as (select feature, avg(value) as mean, stddev_pop(value) as sd from long group by feature)
        select l.feature, round(any_value(mean), 6) as mean, round(any_value(sd), 6) as sd,
               round(min((value - mean) / sd), 6) as low, round(max((value - mean) / sd), 6) as high
        from long l join t on l.feature = t.feature group by l.feature"""
)
def standardize_global(spark, sf):
    long = wide_long(spark, sf)
    z = standardize(long).groupBy("feature").agg(r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"))
    return z.join(rounded(scale_table(long), "mean", "sd"), "feature")


@query(
    f"""with {WIDE_SQL}, folded as (
          select vec_id, cast((row_number() over (order by label, md5(concat('42-0:', vec_id)), vec_id) - 1) % 5 as integer) as fold from wide),
        tagged as (select long.*, fold from long join folded using (vec_id)),
        folds as (select unnest(range(5)) as f),
        t as (select cast(f as integer) as fold, feature, avg(value) as mean, stddev_pop(value) as sd
              from tagged, folds where fold <> f group by f, feature)
        select t.fold, t.feature, round(any_value(mean), 6) as mean, round(any_value(sd), 6) as sd,
               round(avg((value - mean) / sd), 6) as test_mean
        from tagged l join t on l.fold = t.fold and l.feature = t.feature group by t.fold, t.feature"""
)
def standardize_train_apply(spark, sf):
    """One scale table per fold from training rows, applied to the test fold."""
    tagged = durable(assign_folds(wide(spark, sf), "vec_id", k=5, seed=42))
    long = explode_features(tagged, ["vec_id", "repeat", "fold"], "embedding")
    t = durable(train_scale_table(train_moments(long, 5)))
    z = apply_scale(long, t, ["repeat", "fold"]).groupBy("repeat", "fold", "feature").agg(r6(F.avg("value")).alias("test_mean"))
    return z.join(rounded(t, "mean", "sd"), ["repeat", "fold", "feature"]).select("fold", "feature", "mean", "sd", "test_mean")


@query(
    f"""with {WIDE_SQL}, ranked as (
          select vec_id, row_number() over (partition by label order by md5(concat('42:', vec_id)), vec_id) as rn,
                 count(*) over (partition by label) as c, count(*) over () as n, label from wide),
        classes as (select distinct label, c, n, ceil(0.2::double * n - 1e-9) as target from ranked),
        shares as (select *, floor(target * c / n) as base, round(target * c / n - floor(target * c / n), 9) as frac from classes),
        quota as (select label, base + case when row_number() over (order by frac desc, label) <= target - sum(base) over () then 1 else 0 end as q from shares),
        split as (select vec_id, case when rn <= q then 'test' else 'train' end as role from ranked join quota using (label)),
        tagged as (select long.*, role from long join split using (vec_id)),
        med as (select feature, median(value) as median from tagged where role = 'train' and value > -0.2 group by feature)
        select l.feature, round(any_value(median), 6) as median,
               count(case when value <= -0.2 then 1 end) as n_filled,
               round(avg(case when value > -0.2 then value else median end), 6) as mean_after
        from tagged l join med m on l.feature = m.feature where role = 'test' group by l.feature"""
)
def clean_new_rows(spark, sf):
    """New rows are filled with medians learned from training rows and nothing is refitted."""
    split = durable(assign_holdout(wide(spark, sf), "vec_id", seed=42))
    long = explode_features(split, ["vec_id", "role"], "embedding")
    long = long.withColumn("value", F.when(F.col("value") > -0.2, F.col("value")))
    meds = durable(median_table(long.filter("role = 'train'")))
    new = long.filter("role = 'test'").withColumn("missing", F.col("value").isNull())
    after = median_fill(new, meds).groupBy("feature").agg(
        F.count(F.when(F.col("missing"), 1)).alias("n_filled"), r6(F.avg("value")).alias("mean_after")
    )
    return after.join(rounded(meds, "median"), "feature")
