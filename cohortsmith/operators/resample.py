"""Synthetic minority rows and balanced bags. Randomness is md5 of seed, row and purpose.

The methods follow Chawla et al. 2002, Han et al. 2005 and He et al. 2008.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, hash_unit
from ..session import join_on, task_count
from .neighbors import nearest_rows
from .ranking import hash_rank


def _class_sizes(df: DataFrame, label: str) -> tuple[int, int]:
    """(minority, majority) rows, label 1 against the rest."""
    r = df.agg(F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) != 1, 1))).first()
    return r[0], r[1]


def _blend(base: str, other: str, u: str):
    return F.zip_with(
        F.col(base).cast("array<double>"), F.col(other), lambda a, b: a + F.col(u) * (b - a)
    )


def _empty(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.limit(0).select(
        F.lit(0).cast("long").alias("synth_id"),
        F.col(id_col).alias("base_id"),
        F.col(id_col).alias("nb_id"),
        F.lit(0.0).alias("u"),
        F.col(vec_col).cast("array<double>").alias("features"),
    )


def _numbered_draws(bases: DataFrame, n_bases: int, rows: int, near: DataFrame, k: int, id_col: str, vec_col: str, seed: int) -> DataFrame:
    """`rows` synthetic rows: draw a base by number, one of its k neighbours and a step."""
    numbered = hash_rank(bases.select(F.col(id_col).alias("base_id"), F.col(vec_col).alias("_bv")), "base_id", seed, out="_no")
    i = F.col("synth_id")
    draws = bases.sparkSession.range(rows).withColumnRenamed("id", "synth_id").select(
        "synth_id",
        (hash_int(seed, i, "base") % n_bases + 1).alias("_no"),
        (hash_int(seed, i, "nb") % k + 1).cast("int").alias("nb_rank"),
        hash_unit(seed, i, "u").alias("u"),
    )
    got = join_on(draws, numbered, ["_no"])
    return _finish(got, near)


def _finish(draws: DataFrame, near: DataFrame) -> DataFrame:
    n = near.select(F.col("id").alias("base_id"), "nb_rank", "nb_id", "nb_vec")
    j = join_on(draws, n, ["base_id", "nb_rank"])
    return j.select("synth_id", "base_id", "nb_id", "u", _blend("_bv", "nb_vec", "u").alias("features"))


def smote(df: DataFrame, id_col: str, vec_col: str, label: str = "label", k: int = 5, seed: int = 42, **search) -> DataFrame:
    """Enough rows between minority neighbours to reach parity. Fewer than two minority
    rows: nothing to draw from, so no rows."""
    n_min, n_maj = _class_sizes(df, label)
    k = min(k, n_min - 1)
    if k < 1 or n_maj <= n_min:
        return _empty(df, id_col, vec_col)
    minority = df.filter(F.col(label) == 1)
    near = nearest_rows(minority, minority, k, id_col, vec_col, **search)
    return _numbered_draws(minority, n_min, n_maj - n_min, near, k, id_col, vec_col, seed)


def majority_share(df: DataFrame, id_col: str, vec_col: str, label: str = "label", m: int = 10, **search) -> DataFrame:
    """Majority rows among the m nearest of all rows, for each minority row."""
    minority = df.filter(F.col(label) == 1)
    near = nearest_rows(minority, df, m, id_col, vec_col, tag_col=label, **search)
    return near.groupBy("id").agg(F.count(F.when(F.col("nb_tag") != 1, 1)).alias("majority"), F.count(F.lit(1)).alias("m"))


def danger_rows(df: DataFrame, id_col: str, vec_col: str, label: str = "label", m: int = 10, **search) -> DataFrame:
    """Minority rows near the border: m/2 <= majority neighbours < m."""
    share = majority_share(df, id_col, vec_col, label, m, **search)
    return share.filter((F.col("majority") >= F.col("m") / 2) & (F.col("majority") < F.col("m")))


def borderline_smote(
    df: DataFrame, id_col: str, vec_col: str, label: str = "label", k: int = 5, m: int = 10, seed: int = 42, **search
) -> DataFrame:
    """smote whose bases are the rows in danger."""
    n_min, n_maj = _class_sizes(df, label)
    k = min(k, n_min - 1)
    if k < 1 or n_maj <= n_min:
        return _empty(df, id_col, vec_col)
    minority = df.filter(F.col(label) == 1)
    danger = danger_rows(df, id_col, vec_col, label, m, **search).select(F.col("id").alias(id_col))
    bases = join_on(minority, danger, [id_col], "left_semi")
    n_bases = bases.count()
    if n_bases == 0:
        return _empty(df, id_col, vec_col)
    near = nearest_rows(minority, minority, k, id_col, vec_col, **search)
    return _numbered_draws(bases, n_bases, n_maj - n_min, near, k, id_col, vec_col, seed)


def repeat_rows(df: DataFrame, count: str, out: str, block: int = 100_000) -> DataFrame:
    """Each row `count` times, numbered from 0. A large count is cut into blocks that are
    spread over the cluster before they unfold."""
    blocks = df.filter(F.col(count) > 0).withColumn(
        "_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / block)))
    )
    first = F.col("_blk") * block
    last = F.least(first + block, F.col(count)) - 1
    spread = blocks.repartition(task_count(df.sparkSession))
    return spread.withColumn(out, F.explode(F.sequence(first, last))).drop("_blk")


def adasyn_quota(df: DataFrame, id_col: str, vec_col: str, label: str = "label", k: int = 5, **search) -> DataFrame:
    """Rows to make from each minority row, in proportion to its majority neighbours."""
    n_min, n_maj = _class_sizes(df, label)
    share = majority_share(df, id_col, vec_col, label, k, **search)
    total = share.agg(F.sum("majority")).first()[0]
    if not total:
        return share.limit(0).select("id", F.lit(0).cast("long").alias("quota"))
    quota = F.round(F.col("majority") / F.lit(float(total)) * F.lit(float(n_maj - n_min))).cast("long")
    return share.select("id", quota.alias("quota"))


def adasyn(df: DataFrame, id_col: str, vec_col: str, label: str = "label", k: int = 5, seed: int = 42, **search) -> DataFrame:
    """Synthetic rows by quota; synth_id counts within a base row."""
    n_min, n_maj = _class_sizes(df, label)
    kk = min(k, n_min - 1)
    if kk < 1 or n_maj <= n_min:
        return _empty(df, id_col, vec_col)
    minority = df.filter(F.col(label) == 1)
    quota = adasyn_quota(df, id_col, vec_col, label, k, **search).withColumnRenamed("id", "base_id")
    near = nearest_rows(minority, minority, kk, id_col, vec_col, **search)
    j, b = F.col("synth_id"), F.col("base_id")
    draws = repeat_rows(quota, "quota", "synth_id").select(
        "synth_id",
        "base_id",
        (hash_int(seed, b, j, "nb") % kk + 1).cast("int").alias("nb_rank"),
        hash_unit(seed, b, j, "u").alias("u"),
    )
    bases = minority.select(F.col(id_col).alias("base_id"), F.col(vec_col).alias("_bv"))
    return _finish(join_on(draws, bases, ["base_id"]), near)


def with_synthetic(train: DataFrame, synthetic: DataFrame, id_col: str, vec_col: str, label: str = "label") -> DataFrame:
    """Training rows and the rows made from them: id (null for made rows), label, features, synthetic.

    Test rows have no way in: the caller passes the training part alone.
    """
    id_type = train.schema[id_col].dataType
    real = train.select(id_col, F.col(label).cast("int").alias(label), F.col(vec_col).cast("array<double>").alias("features"), F.lit(False).alias("synthetic"))
    made = synthetic.select(F.lit(None).cast(id_type).alias(id_col), F.lit(1).alias(label), "features", F.lit(True).alias("synthetic"))
    return real.unionByName(made)


def balanced_bags(df: DataFrame, id_col: str, label: str = "label", bags: int = 100, seed: int = 42) -> DataFrame:
    """bag, label, id, multiplicity: each bag draws as many rows of every class, with
    replacement, as the rarest class has."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    least = sizes.agg(F.min("_size")).first()[0] or 0
    ranked = hash_rank(df.select(id_col, label), id_col, seed, by=[label], out="_no")
    draws = repeat_rows(sizes.withColumn("_all", F.lit(bags * least)), "_all", "_d")
    draws = draws.select(
        F.floor(F.col("_d") / max(1, least)).cast("int").alias("bag"), label, "_size", (F.col("_d") % max(1, least)).alias("_j")
    )
    draws = draws.withColumn("_no", hash_int(seed, F.col("bag"), F.col(label), F.col("_j")) % F.col("_size") + 1)
    hit = draws.groupBy("bag", label, "_no").agg(F.count(F.lit(1)).alias("multiplicity"))
    return join_on(hit, ranked, [label, "_no"]).select("bag", label, id_col, "multiplicity")
