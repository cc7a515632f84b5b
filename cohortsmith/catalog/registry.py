"""Query registry and the cohorts the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shape import explode_features, unpivot_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its own name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(col: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


# ---- wide cohort: embeddings, label 0 is the rare positive class ---------------


def wide(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.when(F.col("label") == 0, 1).otherwise(0).alias("label"), "embedding")


def wide_long(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return explode_features(wide(spark, sf), ["vec_id", "label", *keep], "embedding")


WIDE_SQL = """
wide as (select vec_id, cast(case when label = 0 then 1 else 0 end as integer) as label, embedding from embeddings),
long as (
  select vec_id, label, cast(generate_subscripts(embedding, 1) - 1 as integer) as feature,
         cast(unnest(embedding) as double) as value
  from wide
)"""

# ---- tall cohort: lineitem, label is a returned item ---------------------------

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def tall(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric columns with gaps, plus an empty, a constant and a half-constant column."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("l_quantity"),
        F.col("l_extendedprice"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"),
        F.col("l_tax"),
        F.lit(None).cast("double").alias("empty"),
        F.lit(3.0).alias("constant"),
        F.when(F.col("l_linenumber") > 3, F.lit(3.0)).alias("half_constant"),
    )


TALL_FEATURES = [*LINE_FEATURES, "empty", "constant", "half_constant"]


def tall_long(spark: SparkSession, sf: str) -> DataFrame:
    return unpivot_features(tall(spark, sf), ["label"], TALL_FEATURES)


TALL_SQL = """
tall as (
  select cast(case when l_returnflag = 'R' then 1 else 0 end as integer) as label,
         case when l_quantity <= 45 then l_quantity end as l_quantity, l_extendedprice,
         case when l_discount > 0 then l_discount end as l_discount, l_tax,
         cast(null as double) as empty, 3.0::double as constant,
         case when l_linenumber > 3 then 3.0::double end as half_constant
  from lineitem
),
long as (
  select label, 'l_quantity' as feature, l_quantity as value from tall
  union all select label, 'l_extendedprice', l_extendedprice from tall
  union all select label, 'l_discount', l_discount from tall
  union all select label, 'l_tax', l_tax from tall
  union all select label, 'empty', empty from tall
  union all select label, 'constant', constant from tall
  union all select label, 'half_constant', half_constant from tall
)"""

# ---- scores: events, three models by user, positive class is an error event ----


def event_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        (F.col("user_id") % 5).cast("int").alias("fold"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        (F.col("value") / F.lit(500.0)).alias("prob"),
    )


SCORES_SQL = """
scores as (
  select event_id, concat('m', cast(user_id % 3 as varchar)) as model, cast(user_id % 5 as integer) as fold,
         cast(case when event_type = 'error' then 1 else 0 end as integer) as label,
         value / 500.0::double as prob
  from events
)"""

# Cumulative counts per distinct score from the top, the base of every curve metric.
POINTS_SQL = (
    SCORES_SQL
    + """,
cells as (
  select model, prob as score, sum(label) as pos, sum(1 - label) as neg from scores group by model, prob
),
points as (
  select model, score, cast(pos as double) as pos, cast(neg as double) as neg,
         cast(sum(pos) over down as double) as run_pos, cast(sum(neg) over down as double) as run_neg,
         cast(sum(pos) over grp as double) as tot_pos, cast(sum(neg) over grp as double) as tot_neg
  from cells
  window down as (partition by model order by score desc rows between unbounded preceding and current row),
         grp as (partition by model)
)"""
)
