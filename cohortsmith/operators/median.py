"""Exact medians of many groups at once, by counting on the bits of the numbers.

A double's 64 bits, with the sign turned, order as the numbers do. Counting rows by their leading 16
bits tells in which cell the middle row of each group lies; only the rows of those cells are kept, as
numbers with counts, and counted by the next 16 bits, and so on. A group has at most 65,536 cells at a
time, counted map-side, so no group is ever sorted and its size does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, join_on

BITS = 16


def ordered_bits(v: Column) -> Column:
    """A long that orders as the doubles do; both zeros are one number."""
    raw = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("long")
    return F.when(raw < 0, raw.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(raw)


def number_of(bits: Column) -> Column:
    """The double that ordered_bits came from."""
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def _cell_of(rank: Column) -> Column:
    """From `cells`, sorted pairs of digit and count: the digit of the row with this rank, and the rows before that cell."""
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast("long").alias("digit"), F.lit(0).cast("long").alias("before"))

    def step(acc: Column, x: Column) -> Column:
        run = acc["run"] + x["c"]
        here = (acc["run"] < rank) & (run >= rank)
        return F.struct(
            run.alias("run"),
            F.when(here, x["digit"]).otherwise(acc["digit"]).alias("digit"),
            F.when(here, acc["run"]).otherwise(acc["before"]).alias("before"),
        )

    return F.aggregate("cells", start, step)


def _sorted_cells(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("digit", "c"))).alias("cells"), F.sum("c").alias("n"))


def exact_median(
    df: DataFrame, value: str, by: Sequence[str] = (), out: str = "median", leave_out: str | None = None, parts: int = 0
) -> DataFrame:
    """Median (mean of the middle two) per group of the cells that are neither null nor NaN.

    With `leave_out`, a column of part numbers 0 to parts-1, there is one median per group and part,
    of the group's rows outside that part: parts are counted once and their counts added up, so no
    row is copied. Groups without a number are absent.
    """
    valid = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    if not by:
        return exact_median(valid.withColumn("_all", F.lit(0)), value, ["_all"], out, leave_out, parts).drop("_all")
    by = list(by)
    own = [*by, leave_out] if leave_out else by
    d = valid.select(*by, *([F.col(leave_out).cast("int").alias(leave_out)] if leave_out else []), ordered_bits(F.col(value).cast("double")).alias("_k"))

    def outside(counts: DataFrame) -> DataFrame:
        """Counts of a part, given to every other part."""
        if not leave_out:
            return counts
        every = F.array(*[F.lit(i) for i in range(parts)])
        return counts.withColumn(leave_out, F.explode(F.array_except(every, F.array(leave_out))))

    def leading(bits: int) -> Column:
        return F.shiftright("_k", 64 - bits)

    counts = outside(d.groupBy(*own, leading(BITS).alias("digit")).agg(F.count(F.lit(1)).alias("c")))
    if leave_out:
        counts = counts.groupBy(*own, "digit").agg(F.sum("c").alias("c"))
    middle = [F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1]
    hits = [F.struct(F.lit(i).alias("half"), _cell_of(r).alias("hit"), r.alias("rank")) for i, r in enumerate(middle)]
    found = _sorted_cells(counts, own).select(*own, F.explode(F.array(*hits)).alias("x"))
    state = found.select(*own, "x.half", F.col("x.hit.digit").alias("prefix"), (F.col("x.rank") - F.col("x.hit.before")).alias("rank"))
    state = durable(state)

    wanted = state.groupBy(*by).agg(F.collect_set("prefix").alias("_wanted"))
    left = join_on(d, wanted, by).filter(F.array_contains("_wanted", leading(BITS)))
    left = durable(left.groupBy(*own, "_k").agg(F.count(F.lit(1)).alias("c")))
    for known in range(BITS, 64, BITS):
        keys = [*own, "half", "prefix", "rank"]
        digit = leading(known + BITS).bitwiseAND(F.lit((1 << BITS) - 1))
        inside = join_on(outside(left), state, own).filter(leading(known) == F.col("prefix"))
        counts = inside.groupBy(*keys, digit.alias("digit")).agg(F.sum("c").alias("c"))
        found = _sorted_cells(counts, keys).withColumn("hit", _cell_of(F.col("rank")))
        state = found.select(
            *own, "half", (F.col("prefix") * (1 << BITS) + F.col("hit.digit")).alias("prefix"), (F.col("rank") - F.col("hit.before")).alias("rank")
        )
    both = state.groupBy(*own).agg(*[F.max(F.when(F.col("half") == i, F.col("prefix"))).alias(f"_{i}") for i in (0, 1)])
    return both.select(*own, ((number_of(F.col("_0")) + number_of(F.col("_1"))) / 2.0).alias(out))
