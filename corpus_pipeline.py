"""A training corpus from raw documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortsmith.llm import catalog
from cohortsmith.llm.contamination import contamination, find_overlap
from cohortsmith.llm.mixing import Target, plan_mixture, realise
from cohortsmith.llm.ngram_join import copies_of_others
from cohortsmith.llm.records import build_index, fresh_folder, write_records
from cohortsmith.llm.toxicity import drop_toxic
from cohortsmith.session import durable, noted, release

#: Most passes over any source; every document is taken once at least.
REPEATS = 2.0

_done: list[str] = []


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Releases what the stage before left behind: its result is written and reread by now. What
    `docs` itself still reads stays."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _done[:] = release(spark, _done, docs)
        with noted() as made:
            out = fn(spark, docs, sf_dir)
        _done.extend(made)
        return out

    return run_stage


def row_name(docs: DataFrame) -> str:
    """A name for row numbers that no column has, in any case."""
    taken, name = {c.lower() for c in docs.columns}, "row_number"
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """A copy of the rows with a number each: ids may be null or repeated."""
    return durable(docs.withColumn(name, F.monotonically_increasing_id()))


def without(rows: DataFrame, name: str, numbers: DataFrame) -> DataFrame:
    """The keyed rows whose number is not among `numbers`, without it."""
    return rows.join(durable(numbers.select(name)), name, "left_anti").drop(name)


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the convolutional classifier calls toxic. Null and empty texts are scored as empty,
    long ones whole, repeated rows alike; an empty table stays one; other columns go through."""
    return drop_toxic(docs, catalog.toxicity_model(spark, docs, sf_dir))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked rows the one with the smallest id. Each row is judged by its
    own text: rows that repeat an id may part, and one without an id stays if no other of its
    group has one. Null and empty texts are linked with nothing and stay; other columns go through
    under any name."""
    name = row_name(docs)
    rows = keyed(docs, name)
    linked = rows.select(F.col(name).alias("node"), F.col("doc_id").cast("long"), "text")
    return without(rows, name, copies_of_others(linked).select(F.col("node").alias(name)))


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows of whose words one in twenty is in a benchmark window. Null and empty texts have no
    words and stay; repeated rows are judged each; other columns go through under any name."""
    name = row_name(docs)
    rows = keyed(docs, name)
    # Written in between: two Python steps of one task would keep twice as many workers, up to the last stage.
    overlap = durable(find_overlap(rows, catalog.table(spark, sf_dir, "benchmark"), id_col=name, nameless=True))
    found = contamination(overlap)
    return without(rows, name, found.filter("contaminated").select(F.col("doc_id").alias(name)))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, up to REPEATS passes: the flattest mixture that
    allows, on the least budget at which no source loses a document."""
    plan = plan_mixture(docs, Target(repeats=REPEATS), budget_share=None, seed=catalog.MIX_SEED)
    return realise(docs, plan, seed=catalog.MIX_SEED).select(docs.columns)


@stage
def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token records and their offset index, and returns what the files hold: a record a
    row, null and empty texts with the end id alone, repeated rows repeated, none of an empty table."""
    path = fresh_folder(spark)
    write_records(docs, path, catalog.tokenizer_path(), end_id=2)
    return build_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_records", token_records),
]

#: No SQL for a trained classifier or a tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each result written before the next reads it."""
    docs, written = catalog.table(spark, sf_dir, "documents"), []
    for _, step in STAGES[:-1]:
        made = step(spark, docs, sf_dir)
        with noted() as now:
            docs = durable(made)
        release(spark, written)  # only the last result is read again
        written = now
    return STAGES[-1][1](spark, docs, sf_dir)
