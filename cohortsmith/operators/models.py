"""Classifiers on the vector form, fitted by Spark ML.

A model here is a Spark ML model whose transform(df) adds `probability`, so a bagged
ensemble, a pipeline and a single estimator are used and saved alike. Training frames
carry label, features and weight.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_folder, join_on, task_count
from .ensemble import TreeEnsembleModel, ensemble_of
from .reduce import ComponentsModel
from .resample import balanced_bags
from .select import FALLBACK_RULES

# Spark's deepest tree; stands for "no limit".
UNLIMITED_DEPTH = 30
# Coefficients smaller than this count as zero.
COEFFICIENT_FLOOR = 1e-5


def run_parallel(jobs: Sequence[Callable], parallelism: int = 4) -> list:
    """Driver threads that only submit Spark jobs; the first error surfaces."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(parallelism) as pool:
        wrap = inheritable_thread_target(SparkSession.getActiveSession())
        futures = [pool.submit(wrap(job)) for job in jobs]
        return [f.result() for f in futures]


def with_unit_weight(df: DataFrame) -> DataFrame:
    return df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0))


def fit_random_forest(train: DataFrame, trees: int = 200, depth: int | None = 5, min_leaf: int = 2, seed: int = 42):
    return RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth or UNLIMITED_DEPTH,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        weightCol="weight",
        seed=seed,
    ).fit(with_unit_weight(train))


def penalty(train: DataFrame, c: float) -> float:
    """Spark averages the loss over the weights: regParam = 1 / (C * sum of weights)."""
    total = train.agg(F.sum("weight")).first()[0]
    return 1.0 / (c * total)


def fit_logistic(train: DataFrame, c: float = 1.0, l1: bool = False, max_iter: int = 200, reg: float | None = None):
    """L1 or L2 logistic regression on features that are already scaled."""
    train = with_unit_weight(train)
    return LogisticRegression(
        regParam=penalty(train, c) if reg is None else reg,
        elasticNetParam=1.0 if l1 else 0.0,
        standardization=False,
        maxIter=max_iter,
        weightCol="weight",
    ).fit(train)


def fit_gbt(train: DataFrame, rounds: int = 100, rate: float = 0.05, depth: int = 2, subsample: float = 1.0, seed: int = 42):
    return GBTClassifier(
        maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, weightCol="weight", seed=seed
    ).fit(with_unit_weight(train))


def fit_balanced_bags(
    train: DataFrame, id_col: str, trees: int = 100, depth: int | None = 5, all_features: bool = False, seed: int = 42, parallelism: int = 4
) -> TreeEnsembleModel:
    """A tree per balanced bag, as one model. With all_features False each tree sees a random
    sqrt-sized choice per split (forest), else every feature (bagging).

    The rows of all bags are joined once and written by bag, so a tree reads its own bag alone; a
    bag is dealt over several tasks where there are more tasks than bags, and as many trees grow at once
    as keep all cores busy, `parallelism` at least. The copy holds two rows of the rare class's number a
    bag, at most.
    """
    spark = train.sparkSession
    rows = train.select(id_col, "label", "features")
    bags = balanced_bags(rows, id_col, bags=trees, seed=seed)
    plan = join_on(bags.select("bag", id_col, F.col("multiplicity").cast("double").alias("weight")), rows, [id_col])
    tasks = task_count(spark)
    each = max(1, tasks // trees)
    part = F.pmod(F.xxhash64(id_col), F.lit(each))
    folder = fresh_folder(spark)
    kept = plan.select("bag", "label", "features", "weight")
    plan.repartition(tasks, "bag", part).select(*kept.columns).write.partitionBy("bag").parquet(f"{folder}/bags")
    schema = kept.drop("bag").schema
    column = {"maxDepth": depth or UNLIMITED_DEPTH, "weightCol": "weight"}

    def job(b: int) -> list[float]:
        bag = spark.read.schema(schema).parquet(f"{folder}/bags/bag={b}")
        if all_features:
            tree = DecisionTreeClassifier(seed=seed + b, **column).fit(bag)
        else:
            one = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed + b, **column)
            tree = one.fit(bag).trees[0]
        tree.write().save(f"{folder}/trees/{b}")
        return tree.featureImportances.toArray().tolist()

    at_once = max(parallelism, -(-spark.sparkContext.defaultParallelism // each))
    weights = run_parallel([lambda b=b: job(b) for b in range(trees)], at_once)
    return ensemble_of(spark, f"{folder}/trees", weights)


def on_column(model, column: str):
    """The fitted model made to read its features from another column."""
    if isinstance(model, PipelineModel):
        first = model.stages[0]
        first._set(**{"inputCol" if first.hasParam("inputCol") else "featuresCol": column})
        return model
    return model.setFeaturesCol(column)


def _unused(models: Sequence, stem: str) -> str:
    """A column name that no stage of the models writes."""
    taken = {s.getOrDefault(s.outputCol) for m in models if isinstance(m, PipelineModel) for s in m.stages if s.hasParam("outputCol")}
    return next(f"{stem}{i}" for i in range(len(taken) + 1) if f"{stem}{i}" not in taken)


def narrowed(model, positions: Sequence[int]) -> PipelineModel:
    """A model fitted on some positions of the feature vector, as stages that read the whole one."""
    column = _unused([model], "_chosen")
    slicer = VectorSlicer(inputCol="features", outputCol=column, indices=list(positions))
    return PipelineModel(stages=[slicer, on_column(model, column)])


def projected(model, pca: ComponentsModel) -> PipelineModel:
    """A model fitted on principal components, with the stage that makes them."""
    return PipelineModel(stages=[pca, on_column(model, pca.getOutputCol())])


def positive_probability(scored: DataFrame) -> Column:
    """Probability of class 1, from a vector or an array column."""
    if isinstance(scored.schema["probability"].dataType, T.ArrayType):
        return F.col("probability")[1]
    return vector_to_array(F.col("probability"))[1]


def score(model, df: DataFrame, keep: Sequence[str], out: str = "prob") -> DataFrame:
    scored = model.transform(df)
    return scored.select(*keep, positive_probability(scored).alias(out))


def predictions_table(model, df: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """id, actual, predicted at 0.5, probability."""
    s = score(model, df, [id_col, label], "probability")
    return s.select(id_col, F.col(label).alias("actual"), (F.col("probability") >= 0.5).cast("int").alias("predicted"), "probability")


def feature_importance(model, names: Sequence[str], spark) -> DataFrame:
    """Importance of a tree model per feature, highest first. One row per feature of a fit."""
    values = model.importances if isinstance(model, TreeEnsembleModel) else model.featureImportances.toArray().tolist()
    rows = [(str(n), float(v)) for n, v in zip(names, values, strict=True)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature"))


def coefficient_importance(model, names: Sequence[str], spark, order: str = "absolute") -> DataFrame:
    """Signed and absolute coefficients, ordered by 'absolute' or 'signed' value."""
    values = model.coefficients.toArray().tolist()
    rows = [(str(n), float(v), abs(float(v))) for n, v in zip(names, values, strict=True)]
    df = spark.createDataFrame(rows, "feature string, coefficient double, importance double")
    first = F.desc("importance") if order == "absolute" else F.desc("coefficient")
    return df.orderBy(first, F.asc("feature"))


def select_l1(train: DataFrame, c: float = 0.1, floor: float = COEFFICIENT_FLOOR) -> list[int]:
    """Positions whose L1 logistic coefficient survives."""
    model = fit_logistic(train, c, l1=True)
    return [i for i, w in enumerate(model.coefficients.toArray().tolist()) if abs(w) >= floor]


def select_l1_or_fallback(
    train: DataFrame, ranked: Sequence[int], c: float = 0.1, fallback_k: int | str = "at_most_25"
) -> tuple[list[int], str]:
    """select_l1, or the leading positions by F when nothing survives. `ranked` are all positions in
    the order of their F; `fallback_k` is how many, or the name of a rule in FALLBACK_RULES."""
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranked must be an order of all positions")
    kept = select_l1(train, c)
    if kept:
        return kept, "l1"
    k = FALLBACK_RULES[fallback_k](len(ranked)) if isinstance(fallback_k, str) else fallback_k
    return list(ranked[: min(k, len(ranked))]), "f_test"
