"""Ranks and running sums that never pull a whole group into one task.

A window partitioned by a class label or a model name puts a third of the table
into one task. The helpers here split every group into buckets, total the buckets
(a small table), and add the running bucket offset to the rank inside the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..session import join_on, task_count


def _window(by: Sequence[str]):
    return W.partitionBy(*[F.col(f"`{c}`") for c in by]) if by else W.partitionBy(F.lit(1))


def _key(cols: Sequence[str]) -> Column:
    """One never-null text key of several columns. A window, an aggregate and a plain
    equi join on it share one partitioning; a null-safe join on the columns would not."""
    parts = ", ".join(f"coalesce(cast(`{c}` as string), '\\u0000')" for c in cols)
    return F.expr(f"concat_ws('\\u0001', {parts})")


def hash_rank(
    df: DataFrame,
    id_col: str,
    seed,
    by: Sequence[str] = (),
    then: Sequence[str] = (),
    out: str = "rank",
    digits: int | None = None,
) -> DataFrame:
    """1-based rank inside each `by` group in the order (then..., md5(seed:id), id).

    md5 spreads the ids evenly, so its leading hex digits cut a group of any size
    into 16**digits buckets of equal size whatever the data looks like. The id must be
    unique within a `by` group.
    """
    if digits is None:
        digits = 3 if task_count(df.sparkSession) <= 512 else 4
    by, then = list(by), list(then)
    d = df.withColumn("_h", digest(seed, F.col(f"`{id_col}`")))
    d = d.withColumn("_b", F.substring("_h", 1, digits))
    d = d.withColumn("_key", _key([*by, *then, "_b"]))
    inner = W.partitionBy("_key").orderBy("_h", id_col)
    ranked = d.select(*[F.col(f"`{c}`") for c in df.columns], "_key", F.row_number().over(inner).alias("_rn"))
    totals = d.groupBy("_key", *by, *then, "_b").agg(F.count(F.lit(1)).alias("_n"))
    running = _window(by).orderBy(*then, "_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = totals.select("_key", (F.sum("_n").over(running) - F.col("_n")).alias("_off"))
    joined = ranked.join(offsets, "_key")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_off") + F.col("_rn")).alias(out))


def bucket_bounds(df: DataFrame, col: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of one column, four for each shuffle partition: buckets shrink as the
    session's partitions grow with the data. Fixed for the plan that uses it."""
    if buckets is None:
        buckets = max(32, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.approxQuantile(col, probs, 1.0 / (4 * buckets))
    inner = sorted(c for c in set(cuts) if math.isfinite(c))
    return [float("-inf"), *inner, float("inf")]


def running_totals(
    points: DataFrame,
    order_col: str,
    cols: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    bounds: list[float] | None = None,
) -> DataFrame:
    """Adds run_<c> (inclusive running sum) and tot_<c> (group sum) to rows that are
    unique on (by, order_col).

    The bounds only spread the work; any bounds give the same result.
    """
    if bounds is None:
        bounds = bucket_bounds(points, order_col)
    if len(bounds) > 2:
        cut = Bucketizer(splits=bounds, inputCol=order_col, outputCol="_b", handleInvalid="keep")
        d = cut.transform(points)
    else:
        d = points.withColumn("_b", F.lit(0.0))
    by = list(by)
    d = d.withColumn("_key", _key([*by, "_b"]))

    def order(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    inside = W.partitionBy("_key").orderBy(order(order_col)).rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = [F.col(f"`{c}`") for c in points.columns]
    local = d.select(*kept, "_key", *[F.sum(c).over(inside).alias(f"_r_{c}") for c in cols])
    per_bucket = d.groupBy("_key", *by, "_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in cols])
    upto = _window(by).orderBy(order("_b")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = _window(by).orderBy(order("_b")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = per_bucket.select(
        "_key",
        *[(F.sum(f"_s_{c}").over(upto) - F.col(f"_s_{c}")).alias(f"_o_{c}") for c in cols],
        *[F.sum(f"_s_{c}").over(whole).alias(f"tot_{c}") for c in cols],
    )
    return local.join(offsets, "_key").select(
        *kept,
        *[(F.col(f"_o_{c}") + F.col(f"_r_{c}")).alias(f"run_{c}") for c in cols],
        *[F.col(f"tot_{c}") for c in cols],
    )


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """The first k rows per group. Spark cuts each map task to k rows before the shuffle:
    by a window group limit, or by a top-k sort when there are no groups."""
    w = _window(list(by)).orderBy(*order)
    if not by:
        df = df.orderBy(*order).limit(k)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
