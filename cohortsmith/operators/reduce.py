"""Principal components, centred, without a width x width matrix.

With fewer rows than columns the n x n products of the rows are summed over chunks of columns and
decomposed (gram). Otherwise a block Krylov space is built: each pass multiplies a few vectors by the
covariance where the rows are, and the driver rotates what came back (krylov). The driver holds some
vectors of the width, or n x n numbers where n is the smaller side.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, task_count

# Tasks receive these functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors beyond those asked for, blocks before a restart, and the residual at which a vector is found.
OVERSAMPLE, BLOCKS, TOLERANCE = 8, 6, 1e-10
#: Columns of a chunk of the gram form.
CHUNK = 512


class ComponentsModel(Model, HasFeaturesCol, HasOutputCol, MLReadable, MLWritable):
    """Projects (x - mean) / scale on the columns of `pc`. `explained` is each component's share of
    the whole variance."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, pc: np.ndarray, explained: np.ndarray):
        super().__init__()
        self.mean, self.scale, self.pc, self.explained = mean, scale, pc, explained
        self._set(outputCol="components")

    @property
    def k(self) -> int:
        return self.pc.shape[1]

    def setFeaturesCol(self, value: str) -> ComponentsModel:
        return self._set(featuresCol=value)

    def first(self, k: int) -> ComponentsModel:
        """The model of the leading k components."""
        return ComponentsModel(self.mean, self.scale, self.pc[:, :k], self.explained[:k])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mean, pc = self.mean, self.pc / self.scale[:, None]

        @F.pandas_udf("array<double>")
        def projected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(list((_matrix(b, len(mean)) - mean) @ pc))

        x = projected(vector_to_array(F.col(self.getFeaturesCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(x))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: ComponentsModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, m = SparkSession.getActiveSession(), self.model
        DefaultParamsWriter.saveMetadata(m, path, spark)
        rows = [(i, float(a), float(b), c.tolist()) for i, (a, b, c) in enumerate(zip(m.mean, m.scale, m.pc))]
        spark.createDataFrame(rows, "feature int, mean double, scale double, weights array<double>").coalesce(1).write.parquet(f"{path}/features")
        shares = [(i, float(x)) for i, x in enumerate(m.explained)]
        spark.createDataFrame(shares, "component int, share double").coalesce(1).write.parquet(f"{path}/components")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ComponentsModel:
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/features").orderBy("feature").collect()
        shares = spark.read.parquet(f"{path}/components").orderBy("component").collect()
        columns = [np.array([r[c] for r in rows], dtype="float64") for c in ("mean", "scale", "weights")]
        model = self.cls(*columns[:2], columns[2].reshape(len(rows), -1), np.array([r["share"] for r in shares]))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


def _matrix(col: pd.Series, width: int) -> np.ndarray:
    return np.array(col.tolist(), dtype="float64").reshape(len(col), width)


def width(df: DataFrame, col: str = "features") -> int:
    return len(df.select(col).first()[0])


def _summed(parts: DataFrame, rows: int) -> np.ndarray:
    """Matrix from (i, v): the vectors of each row number added up."""
    total = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
    return np.array([r["v"].toArray() for r in sorted(total, key=lambda r: r["i"])]).reshape(rows, -1)


def _rows_of(m: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": np.arange(len(m)), "v": list(m)})


def _times_covariance(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Xc' Xc q in one pass. A task adds up its batches, and there are no more tasks than cores have use for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(q.shape)
        for b in batches:
            x = (_matrix(b["x"], len(mean)) - mean) / scale
            total += x.T @ (x @ q)
        for lo in range(0, len(total), 1_000):
            yield pd.DataFrame({"i": np.arange(lo, min(lo + 1_000, len(total))), "v": list(total[lo : lo + 1_000])})

    return _summed(rows.coalesce(task_count(rows.sparkSession)).mapInPandas(run, "i int, v array<double>"), len(mean))


def _krylov(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading k eigenvalues and eigenvectors of Xc' Xc."""
    p = len(mean)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, min(p, k + OVERSAMPLE))))[0]
    basis, image = np.zeros((p, 0)), np.zeros((p, 0))
    while True:
        image = np.hstack([image, _times_covariance(rows, mean, scale, block)])
        basis = np.hstack([basis, block])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][: k + OVERSAMPLE]
        values, turn = values[order], turn[:, order]
        vectors, images = basis @ turn, image @ turn
        left = np.linalg.norm(images[:, :k] - vectors[:, :k] * values[:k], axis=0).max(initial=0)
        if basis.shape[1] >= p or left <= TOLERANCE * max(values[0], 1e-300):
            return values[:k], vectors[:, :k]
        fresh = images - vectors * values if basis.shape[1] >= BLOCKS * (k + OVERSAMPLE) else image[:, -block.shape[1] :]
        if basis.shape[1] >= BLOCKS * (k + OVERSAMPLE):
            basis, image = vectors, images  # restart from the best found
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        u, s, _ = np.linalg.svd(fresh, full_matrices=False)
        block = u[:, s > 1e-12 * max(values[0], 1e-300)][:, : p - basis.shape[1]]
        for _ in range(2):
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        if not block.shape[1]:  # nothing of the rows lies outside the basis
            return values[:k], vectors[:, :k]


def _gram(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the n x n products of the rows, summed over chunks of columns."""
    p = len(mean)
    parts = -(-p // CHUNK)
    numbered = durable(rows.select(F.monotonically_increasing_id().alias("row"), "x"))
    chunk = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda c: F.struct(c.alias("chunk"), F.slice("x", c * CHUNK + 1, CHUNK).alias("part"))))
    chunks = durable(numbered.select("row", chunk.alias("c")).select("row", "c.chunk", "c.part").repartition(parts, "chunk"))

    def columns(d: pd.DataFrame) -> tuple[int, np.ndarray]:
        c = int(d["chunk"].iloc[0]) * CHUNK
        x = np.array(d.sort_values("row")["part"].tolist(), dtype="float64")
        return c, (x - mean[c : c + CHUNK]) / scale[c : c + CHUNK]

    def products(d: pd.DataFrame) -> pd.DataFrame:
        _, x = columns(d)
        return _rows_of(x @ x.T)

    gram = _summed(chunks.groupBy("chunk").applyInPandas(products, "i int, v array<double>"), n)
    values, u = np.linalg.eigh((gram + gram.T) / 2)
    values, u = np.maximum(values[::-1][:k], 0), u[:, ::-1][:, :k]
    turn = u / np.sqrt(np.maximum(values, 1e-300))

    def weights(d: pd.DataFrame) -> pd.DataFrame:
        c, x = columns(d)
        return _rows_of(x.T @ turn).assign(i=lambda t: t["i"] + c)

    return values, _summed(chunks.groupBy("chunk").applyInPandas(weights, "i int, v array<double>"), p)


def fit_pca(train: DataFrame, k: int, col: str = "features", scale: bool = False, solver: str | None = None, seed: int = 5) -> ComponentsModel:
    """Centre (and scale) by the training rows, then the k leading components; k is cut to
    min(n-1, p). `solver` is 'gram' or 'krylov', by default the one for the smaller side. A
    component's largest weight is positive."""
    facts = train.select(
        Summarizer.metrics("count", "mean", "variance").summary(F.col(col)).alias("s")
    ).select("s.count", "s.mean", "s.variance").first()
    n, mean, variance = facts[0], facts[1].toArray(), facts[2].toArray()
    p = len(mean)
    k = max(1, min(k, n - 1, p))
    spread = np.sqrt(variance) if scale else np.ones(p)
    spread[spread == 0] = 1.0
    rows = train.select(vector_to_array(col).alias("x"))
    if solver is None:
        solver = "gram" if n < p else "krylov"
    if solver not in ("gram", "krylov"):
        raise ValueError("solver must be 'gram' or 'krylov'")
    values, pc = _gram(rows, mean, spread, k, n) if solver == "gram" else _krylov(rows, mean, spread, k, seed)
    pc = pc * np.where(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])] < 0, -1.0, 1.0)
    total = float((variance / spread**2).sum()) * max(1, n - 1)
    model = ComponentsModel(mean, spread, pc, values / total if total else np.zeros(len(values)))
    return model.setFeaturesCol(col)


def fit_pca_variance(train: DataFrame, share: float = 0.95, col: str = "features", solver: str | None = None) -> ComponentsModel:
    """The fewest components whose explained variance reaches the share. Twice as many are looked
    for until they do, so the work follows the number that is needed."""
    k, most = 32, min(width(train, col), max(1, train.count() - 1))
    while True:
        model = fit_pca(train, min(k, most), col, solver=solver)
        upto = model.explained.cumsum()
        if upto[-1] >= share - 1e-12 or model.k >= most:
            return model.first(min(model.k, int((upto < share - 1e-12).sum()) + 1)).setFeaturesCol(col)
        k *= 2


def project(model: ComponentsModel, df: DataFrame) -> DataFrame:
    return model.transform(df)
