"""Shapes of physical plans."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from cohortsmith.catalog.registry import tall_long, wide
from cohortsmith.operators.folds import assign_folds
from cohortsmith.operators.select import anova_f, select_k_best


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_used_columns(spark, sf):
    p = plan_of(queries()["drop_metadata"](spark, sf))
    schema = p[p.index("ReadSchema") :]
    assert "o_totalprice" in schema and "o_orderstatus" not in schema


def test_null_label_filter_reaches_the_scan(spark, sf):
    p = plan_of(queries()["index_filter"](spark, sf))
    assert "IsNotNull(quality)" in p


def test_profile_is_one_scan_with_partial_aggregates(spark, sf):
    p = plan_of(queries()["constant_filter"](spark, sf))
    assert p.count("FileScan") == 1
    assert p.count("Exchange hashpartitioning") == 1
    assert "partial_" in p


def test_f_test_reads_rows_once(spark, sf):
    p = plan_of(anova_f(tall_long(spark, sf)))
    assert p.count("FileScan") == 1


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    long = tall_long(spark, sf)
    assert "TakeOrderedAndProject" in plan_of(select_k_best(anova_f(long), 3))
    p = plan_of(queries()["top_k_features"](spark, sf))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_fold_window_is_split_by_hash_bucket(spark, sf):
    """No window of a fold plan over rows is partitioned by repeat or label alone."""
    p = plan_of(assign_folds(wide(spark, sf), "vec_id"))
    row_windows = [line for line in p.splitlines() if "row_number()" in line and "Window [" in line]
    assert row_windows
    assert all("_key#" in line.split("windowspecdefinition")[1].split("ASC")[0] for line in row_windows)
    assert wide(spark, sf).select(F.count("*")).first()[0] == 500


def test_rank_join_keeps_the_window_partitioning(spark, sf):
    """Without a broadcast the ranked rows are shuffled once, not again for the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(assign_folds(wide(spark, sf), "vec_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with_rows = [line for line in p.splitlines() if "Exchange hashpartitioning" in line]
    # Rows by bucket, bucket totals, running offsets per repeat, offsets by bucket.
    assert len(with_rows) == 4
