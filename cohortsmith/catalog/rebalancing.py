"""Resamplers on the wide cohort, all its dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as R
from ..operators.folds import assign_holdout
from ..operators.neighbors import nearest_rows, recall
from ..session import durable
from .registry import WIDE_SQL, query, r6, wide
from .splitting import _holdout_sql


DIMS = 64


def _cohort(spark, sf):
    return wide(spark, sf).withColumn("x", F.col("embedding").cast("array<double>")).drop("embedding")


def _show(made):
    return made.select(
        "synth_id", "base_id", "nb_id", *[r6(F.col("features")[i]).alias(f"x{i}") for i in range(DIMS)]
    )


# Points, the k nearest minority rows of each minority row, and counts.
NEAR_SQL = WIDE_SQL + """,
pts as (select vec_id as id, label, cast(embedding as double[]) as v from wide),
mino as (select * from pts where label = 1),
sizes as (select cast(sum(label) as bigint) as n_min, cast(sum(1 - label) as bigint) as n_maj from pts),
nb as (select * from (select q.id as base_id, p.id as nb_id, row_number() over (partition by q.id order by
         list_distance(q.v, p.v), p.id) as nb_rank
       from mino q join mino p on q.id <> p.id) where nb_rank <= 5),
around as (select base_id, nb_rank, label from (select q.id as base_id, p.label, row_number() over (partition by q.id order by
         list_distance(q.v, p.v), p.id) as nb_rank
       from mino q join pts p on q.id <> p.id) where nb_rank <= 10)"""


def _h(*parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) as bigint)"


_BLEND = ", ".join(f"round(q.v[{i + 1}] + u * (p.v[{i + 1}] - q.v[{i + 1}]), 6) as x{i}" for i in range(DIMS))
_DRAWS = f"""
numbered as (select id as base_id, row_number() over (order by md5(concat('42:', id)), id) as no, count(*) over () as n from bases),
draws as (select i as synth_id, {_h("'42'", 'i', "'base'")} % (select any_value(n) from numbered) + 1 as no,
                 {_h("'42'", 'i', "'nb'")} % 5 + 1 as nb_rank, {_h("'42'", 'i', "'u'")} / 1152921504606846976.0::double as u
          from (select unnest(range((select n_maj - n_min from sizes))) as i)),
made as (select synth_id, base_id, nb_id, u from draws join numbered using (no) join nb using (base_id, nb_rank))
select synth_id, base_id, nb_id, {_BLEND} from made join pts q on q.id = base_id join pts p on p.id = nb_id"""


@query(f"with {NEAR_SQL}, bases as (select id from mino), {_DRAWS}")
def smote(spark, sf):
    return _show(R.smote(_cohort(spark, sf), "vec_id", "x"))


@query(
    f"""with {NEAR_SQL}, bases as (
          select base_id as id from around group by base_id
          having sum(1 - label) >= count(*) / 2 and sum(1 - label) < count(*)), {_DRAWS}"""
)
def borderline_smote(spark, sf):
    return _show(R.borderline_smote(_cohort(spark, sf), "vec_id", "x"))


@query(
    f"""with {NEAR_SQL},
        r as (select base_id, sum(1 - label) as majority from around where nb_rank <= 5 group by base_id),
        quota as (select base_id, cast(round(cast(majority as double) / cast((select sum(majority) from r) as double)
                         * cast((select n_maj - n_min from sizes) as double)) as bigint) as quota from r),
        draws as (select base_id, synth_id, {_h("'42'", 'base_id', 'synth_id', "'nb'")} % 5 + 1 as nb_rank,
                         {_h("'42'", 'base_id', 'synth_id', "'u'")} / 1152921504606846976.0::double as u
                  from (select base_id, unnest(range(quota)) as synth_id from quota))
        select synth_id, base_id, nb_id, {_BLEND} from draws join nb using (base_id, nb_rank)
        join pts q on q.id = base_id join pts p on p.id = nb_id"""
)
def adasyn(spark, sf):
    return _show(R.adasyn(_cohort(spark, sf), "vec_id", "x"))


@query(
    f"""with {WIDE_SQL}, {_holdout_sql('wide', 'vec_id', 42, '')},
        n as (select role, label, count(*) as n from split group by role, label)
        select role, label, false as synthetic, n from n
        union all select 'train', 1, true, (select n from n where role = 'train' and label = 0) - n from n where role = 'train' and label = 1"""
)
def resample_train_only(spark, sf):
    """Made rows join the training part; the test part is untouched."""
    split = durable(assign_holdout(_cohort(spark, sf), "vec_id", seed=42))
    train = split.filter("role = 'train'")
    both = R.with_synthetic(train, R.smote(train, "vec_id", "x"), "vec_id", "x").withColumn("role", F.lit("train"))
    test = split.filter("role = 'test'").select("role", "label", F.lit(False).alias("synthetic"))
    rows = both.select("role", "label", "synthetic").unionByName(test)
    return rows.groupBy("role", "label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {WIDE_SQL},
        ranked as (select vec_id, label, row_number() over (partition by label order by md5(concat('42:', vec_id)), vec_id) as no,
                          count(*) over (partition by label) as n_c from wide),
        c as (select distinct label, n_c from ranked), least as (select min(n_c) as m from c),
        draws as (select bag, label, {_h("'42'", 'bag', 'label', 'j')} % n_c + 1 as no
                  from c, (select unnest(range(20)) as bag), (select unnest(range((select m from least))) as j))
        select cast(bag as integer) as bag, d.label, vec_id, count(*) as multiplicity
        from draws d join ranked r on d.label = r.label and d.no = r.no group by bag, d.label, vec_id"""
)
def balanced_bootstrap(spark, sf):
    return R.balanced_bags(wide(spark, sf), "vec_id", bags=20)


@query(f"with {WIDE_SQL} select 5 * count(*) as wanted, true as recall_is_high from wide")
def lsh_recall(spark, sf):
    """The 5 nearest rows of every row by random projections, measured against the exact search."""
    rows = wide(spark, sf)
    exact, found = (durable(nearest_rows(rows, rows, 5, "vec_id", "embedding", method=m, vectors=False).select("id", "dist2")) for m in ("exact", "lsh"))
    return recall(found, exact).select("wanted", (F.col("recall") >= 0.9).alias("recall_is_high"))
