"""Labels and text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import labels as L
from ..operators.columns import drop_by_substring, drop_columns, profile_features, variance_above
from ..operators.impute import clinical_features, fill_zero_columns
from ..operators.labels import class_balance as balance_row
from ..operators.labels import class_counts as count_classes
from ..operators.labels import drop_unlabeled as keep_labeled_rows
from ..operators.labels import require_two_classes
from ..operators.labels import target_distribution as distribution
from ..operators.report import run_metadata as metadata_row
from ..sources.readers import load_cohort as read_cohort
from ..sources.readers import require_columns
from .registry import WIDE_SQL, query, rounded, table, wide, wide_long

NAME_CONTROLS = (" widget", " gear")


@query(
    """select p_partkey, cast(case when p_name like '% widget' or p_name like '% gear' then 0 else 1 end as integer)
       as label from part"""
)
def label_suffix_lenient(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", L.label_suffix_lenient(F.col("p_name"), NAME_CONTROLS).alias("label")
    )


@query(
    """select p_partkey, cast(case when trim(p_name) like '% widget' or trim(p_name) like '% gear' then 0
         when trim(p_name) like 'hot %' then 1 else -1 end as integer) as label from part"""
)
def label_suffix_strict(spark, sf):
    strict = L.label_suffix_strict(F.col("p_name"), NAME_CONTROLS, "hot ")
    return table(spark, sf, "part").select("p_partkey", F.coalesce(strict, F.lit(-1)).alias("label"))


def _partly_labeled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


@query(
    """select d.doc_id, cast(case when toxic > 0 then 1 else 0 end as integer) as zero_policy,
         cast(case when toxic is null then -1 when toxic > 0 then 1 else 0 end as integer) as keep_policy
       from documents d left join labels l on d.doc_id = l.doc_id"""
)
def binarize_target(spark, sf):
    return _partly_labeled(spark, sf).select(
        "doc_id",
        L.binarize_target(F.col("toxic")).alias("zero_policy"),
        F.coalesce(L.binarize_target(F.col("toxic"), "keep"), F.lit(-1)).alias("keep_policy"),
    )


@query("select d.doc_id, cast(quality as integer) as quality from documents d join labels l on d.doc_id = l.doc_id where quality is not null")
def drop_unlabeled(spark, sf):
    return keep_labeled_rows(_partly_labeled(spark, sf).select("doc_id", "quality"), "quality")


@query(f"with {WIDE_SQL} select label, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from wide group by label")
def class_counts(spark, sf):
    return rounded(count_classes(wide(spark, sf)), "share")


@query(
    f"""with {WIDE_SQL}, c as (
          select count(*) as n, cast(sum(label) as bigint) as n_pos, cast(sum(1 - label) as bigint) as n_neg from wide)
        select n, n_pos, n_neg, round(n_pos / n, 6) as prevalence, round(n_neg / n_pos, 6) as neg_per_pos,
               round((n_pos / n) * (1 - n_pos / n), 6) as brier_baseline from c"""
)
def class_balance(spark, sf):
    checked = require_two_classes(wide(spark, sf))
    return rounded(balance_row(checked), "prevalence", "neg_per_pos", "brier_baseline")


@query("select label, count(*) as n from embeddings group by label")
def target_distribution(spark, sf):
    return distribution(table(spark, sf, "embeddings"), "label")


@query(
    f"""with {WIDE_SQL},
        kept as (select count(*) as n from (select feature from long group by feature having var_pop(value) > 1.0 / 64))
        select count(*) as n_samples, (select n from kept) as n_features_after_filter,
          cast(sum(label) as bigint) as n_pos, cast(sum(1 - label) as bigint) as n_neg,
          cast(5 as integer) as n_splits, cast(3 as integer) as n_repeats from wide"""
)
def run_metadata(spark, sf):
    """The width is measured: features of more than the mean variance of unit vectors."""
    w = wide(spark, sf)
    kept = variance_above(profile_features(wide_long(spark, sf)), 1.0 / 64).filter("kept").count()
    return metadata_row(w, kept, {"n_splits": 5, "n_repeats": 3})


@query("select c_custkey, c_mktsegment from customer")
def load_cohort(spark, sf):
    c = read_cohort(spark, f"{sf}/customer.parquet")
    return require_columns(c, ["c_custkey", "c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("select o_custkey, o_totalprice from orders")
def drop_metadata(spark, sf):
    """A deny-list with an absent name, then a substring; the scan reads what is left."""
    o = drop_columns(table(spark, sf, "orders"), ["o_orderstatus", "o_comment"])
    return drop_by_substring(o, "o_order")


def _messy(spark, sf):
    """events with odd cells written over the number in props."""
    e = table(spark, sf, "events")
    m = F.col("event_id") % 11
    raw = F.get_json_object("props", "$.k")
    for i, odd in enumerate(ODD_CELLS):
        raw = F.when(m == i, F.lit(odd)).otherwise(raw)
    return e.select("event_id", "event_type", raw.alias("raw"))


# Cells that must not slip through the number parser, and two that must parse.
ODD_CELLS = ("NaN;", " ", "1d", "1_000", "Infinity", " 2 ", "1e3", "abc", "-NaN-")
_ODD_SQL = " ".join(f"when event_id % 11 = {i} then '{odd}'" for i, odd in enumerate(ODD_CELLS))
MESSY_SQL = f"""
messy as (select event_id, event_type, case {_ODD_SQL} else json_extract_string(props, '$.k') end as raw from events),
cleaned as (
  select *, case when raw in ('NaN;', 'NaN', 'nan', '', ' ') then null else raw end as token,
         case when raw like '%NaN%' or trim(raw) = '' then null else raw end as nan_text
  from messy
),
numbers as (
  select *, case when regexp_matches(trim(token), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
                 then try_cast(trim(token) as double) end as value
  from cleaned
)"""


@query(
    f"""with {MESSY_SQL} select event_id, coalesce(token, '<null>') as token, coalesce(nan_text, '<null>') as nan_text,
          coalesce(value, -1.0::double) as value from numbers"""
)
def clean_numeric(spark, sf):
    raw = F.col("raw")
    return _messy(spark, sf).select(
        "event_id",
        F.coalesce(C.sentinel_to_null(raw), F.lit("<null>")).alias("token"),
        F.coalesce(C.contains_nan_to_null(raw), F.lit("<null>")).alias("nan_text"),
        F.coalesce(C.clean_numeric(raw), F.lit(-1.0)).alias("value"),
    )


@query(
    f"""with {MESSY_SQL} select event_type, count(*) as n, count(value) as n_valid,
          sum(coalesce(value, 0.0::double)) as total from numbers group by event_type"""
)
def fill_zero(spark, sf):
    d = _messy(spark, sf).withColumn("value", C.clean_numeric(F.col("raw")))
    d = d.withColumn("valid", F.col("value").isNotNull())
    return fill_zero_columns(d, ["value"]).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"), F.sum("value").alias("total")
    )


@query(
    """select c_custkey, coalesce(case when c_acctbal > 0 then c_acctbal end, 0.0::double) as balance,
         coalesce(cast(c_nationkey as double), 0.0::double) as nation from customer"""
)
def clinical_fields(spark, sf):
    c = table(spark, sf, "customer")
    d = c.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").alias("nation"))
    return clinical_features(d, "c_custkey", ["balance", "nation"])
