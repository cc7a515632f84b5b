"""Queries of this subpackage over the driver tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat as CH
from . import contamination as CO
from . import digest as DI
from . import divergence as DV
from . import language as LA
from . import mixing as MI
from . import ngram_join as NG
from . import records as RE
from . import repair as RR
from . import repeats as RP
from . import secrets as SE
from . import shards as SH
from . import toxicity as TO
from .common import held_out

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


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op2_token_records(spark, sf):
    """Token ids of all documents as framed records, read back through the offset index."""
    path = RE.fresh_folder(spark)
    RE.write_records(table(spark, sf, "documents"), path, tokenizer_path(), end_id=2)
    index = RE.build_index(spark, path)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


@query()
def op3_rank_profiles(spark, sf):
    """Language of every document by rank-order n-gram profiles."""
    docs = table(spark, sf, "documents")
    profiles = LA.fit_profiles(docs.filter(~held_out(F.col("doc_id"))))
    return LA.identify(docs, profiles, keep={"held_out": held_out(F.col("doc_id"))})


@query()
def op6_feistel_shards(spark, sf):
    """All documents in 40 shards by a Feistel permutation of their row numbers."""
    placed = SH.feistel_shards(table(spark, sf, "documents"), 40, key=2024)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row"
    )


def toxicity_model(spark: SparkSession, docs: DataFrame, sf: str) -> TO.Classifier:
    return TO.fit_on_all(docs.filter(~held_out(F.col("doc_id"))), table(spark, sf, "labels"))


@query()
def op7_cnn_toxicity(spark, sf):
    """Toxicity of every document by the convolutional classifier."""
    docs = table(spark, sf, "documents")
    model = toxicity_model(spark, docs, sf)
    return TO.score_toxicity(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out(F.col("doc_id"))})


@query()
def op8_prefix_containment(spark, sf):
    """Benchmark windows in all documents."""
    return CO.contamination(CO.find_overlap(table(spark, sf, "documents"), table(spark, sf, "benchmark"), nameless=True))


@query(CH.rotation_sql())
def op1_perspective_rotation(spark, sf):
    """Every conversation from the side of each participant."""
    return CH.rotate_perspectives(table(spark, sf, "conversations"))


ENTROPY, MIX_SEED = 0.95, 11


@query(MI.mixture_sql(ENTROPY, MIX_SEED))
def op9_temperature_mixture(spark, sf):
    """All sources mixed to 95 % of the highest entropy, on a budget of as many tokens as there are."""
    docs = table(spark, sf, "documents")
    plan = MI.plan_mixture(docs, MI.Target(entropy=ENTROPY), budget_share=1.0, seed=MIX_SEED)
    drawn = MI.realise(docs.select("doc_id", "source", "text"), plan, seed=MIX_SEED)
    return drawn.select(
        F.coalesce("source", F.lit("")).alias("source_key"), "doc_id", MI.count_tokens().alias("tokens"), F.col("__block").alias("block"), F.col("__key").alias("place")
    )


@query()
def op10_jaccard_tiles(spark, sf):
    """Components of all documents that share four fifths of their word 5-shingles."""
    return NG.jaccard_components(table(spark, sf, "documents"))


@query()
def op4_rarity_digest(spark, sf):
    """Digest of every document and of its edited text."""
    return DI.digests(table(spark, sf, "documents"))


@query()
def op5_run_length_repeats(spark, sf):
    """All documents without the bytes of strings of 400 bytes that start twice."""
    return RP.remove_repeats(table(spark, sf, "documents")).drop("kept")


@query(SE.secrets_sql())
def op13_ownership_secrets(spark, sf):
    """Secrets of all documents; unannounced ones by the owners of their hash over the corpus."""
    return SE.scan_secrets(table(spark, sf, "documents"))


@query(DV.divergence_sql())
def op12_source_divergence(spark, sf):
    """Distances between the sources of each language, and the words each source favours."""
    return DV.audit_sources(table(spark, sf, "documents"))


@query()
def op11_dialogue_repair(spark, sf):
    """The cheapest repair of every conversation after planted damage."""
    return RR.audit_damaged(table(spark, sf, "conversations"))
