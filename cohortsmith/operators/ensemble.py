"""A bagged ensemble of trees as one Spark ML model: one scoring stage, one folder on disk.

The trees are Spark ML's own. Their nodes, as Spark saves them, become one table of numbers: scoring
walks all trees of a batch at once, so a plan is as short for 400 trees as for one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable

# Tasks receive these functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows times trees that a task walks at once.
WALK = 1 << 20
NODES = "tree int, node int, left int, right int, feature int, threshold double, value double"


def walk(x: np.ndarray, nodes: dict[str, np.ndarray]) -> np.ndarray:
    """Mean leaf value over all trees of each row of x."""
    roots = np.flatnonzero(nodes["node"] == 0)
    first = np.repeat(roots, np.diff([*roots, len(nodes["node"])]))  # nodes are numbered within their tree
    left, right, feature = nodes["left"] + first, nodes["right"] + first, nodes["feature"]
    out = np.empty(len(x))
    step = max(1, WALK // max(1, len(roots)))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        at = np.repeat(roots[None, :], len(part), axis=0)
        inner = feature[at] >= 0
        while inner.any():
            r, c = np.nonzero(inner)
            here = at[r, c]
            at[r, c] = np.where(part[r, feature[here]] <= nodes["threshold"][here], left[here], right[here])
            inner[r, c] = feature[at[r, c]] >= 0
        # Left to right, as a sum over single trees would be.
        out[lo : lo + step] = np.cumsum(nodes["value"][at], axis=1)[:, -1] / len(roots)
    return out


class TreeEnsembleModel(Model, HasFeaturesCol, HasProbabilityCol, MLReadable, MLWritable):
    """Mean positive probability of trees. `nodes` is in the order of tree and node; a node that
    has feature -1 is a leaf, and `left` and `right` count within the tree."""

    def __init__(self, nodes: dict[str, np.ndarray], importances: Sequence[float]):
        super().__init__()
        self.nodes = nodes
        self.importances = [float(x) for x in importances]

    @property
    def n_trees(self) -> int:
        return int((self.nodes["node"] == 0).sum())

    def setFeaturesCol(self, value: str) -> TreeEnsembleModel:
        return self._set(featuresCol=value)

    def setProbabilityCol(self, value: str) -> TreeEnsembleModel:
        return self._set(probabilityCol=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        nodes = self.nodes

        @F.pandas_udf("double")
        def positive(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                x = np.array(b.tolist(), dtype="float64").reshape(len(b), -1)
                yield pd.Series(walk(x, nodes))

        p = positive(vector_to_array(F.col(self.getFeaturesCol())))
        name = "_positive"
        while name in dataset.columns:
            name += "_"
        scored = dataset.withColumn(name, p)
        both = array_to_vector(F.array(1 - F.col(name), F.col(name)))
        return scored.withColumn(self.getProbabilityCol(), both).drop(name)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: TreeEnsembleModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        names = [c.split()[0] for c in NODES.split(", ")]
        table = pd.DataFrame({n: self.model.nodes[n] for n in names})
        spark.createDataFrame(table, NODES).coalesce(1).write.parquet(f"{path}/nodes")
        weights = [(i, w) for i, w in enumerate(self.model.importances)]
        spark.createDataFrame(weights, "feature int, importance double").coalesce(1).write.parquet(f"{path}/importances")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TreeEnsembleModel:
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        weights = spark.read.parquet(f"{path}/importances").orderBy("feature").collect()
        model = self.cls(collect_nodes(spark.read.parquet(f"{path}/nodes")), [r["importance"] for r in weights])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


def collect_nodes(table: DataFrame) -> dict[str, np.ndarray]:
    """The nodes as arrays in the order of tree and node: a fitted model, not data."""
    d = table.orderBy("tree", "node").toPandas()
    kinds = {"feature": "int32", "threshold": "float64", "value": "float64"}
    return {c: d[c].to_numpy(kinds.get(c, "int32")) for c in d.columns}


def saved_nodes(spark: SparkSession, folder: str, trees: int) -> DataFrame:
    """Node table of trees that Spark ML saved as folder/0, folder/1 and so on. The value of a
    node is the share of class 1 among the weights of its training rows."""
    file = F.regexp_extract(F.input_file_name(), r"/(\d+)/data/[^/]*$", 1).cast("int")
    raw = spark.read.parquet(*[f"{folder}/{i}/data" for i in range(trees)]).select(file.alias("tree"), "*")
    stats = F.col("impurityStats")
    share = F.coalesce(F.try_element_at(stats, F.lit(2)), F.lit(0.0)) / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    leaf = F.col("leftChild") < 0
    return raw.select(
        "tree",
        F.col("id").alias("node"),
        F.greatest("leftChild", F.lit(0)).alias("left"),
        F.greatest("rightChild", F.lit(0)).alias("right"),
        F.when(leaf, -1).otherwise(F.col("split.featureIndex")).cast("int").alias("feature"),
        F.when(leaf, F.lit(0.0)).otherwise(F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1))).alias("threshold"),
        share.alias("value"),
    )


def ensemble_of(spark: SparkSession, folder: str, importances: Sequence[Sequence[float]]) -> TreeEnsembleModel:
    """One model of the trees saved under the folder; its importances are the mean of theirs."""
    nodes = collect_nodes(durable(saved_nodes(spark, folder, len(importances))))
    return TreeEnsembleModel(nodes, np.mean(np.array(importances, dtype="float64"), axis=0))
