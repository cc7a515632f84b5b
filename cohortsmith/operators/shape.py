"""Long form (row_id, feature, value) and vector form of a cohort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import nan_to_null

# Wider generated methods than this fall out of whole-stage codegen.
UNPIVOT_CHUNK = 2_000


def unpivot_features(df: DataFrame, keep: Sequence[str], features: Sequence[str], cast: str | None = "double") -> DataFrame:
    """One output row per (row, feature); very wide tables are unpivoted in column chunks."""
    features = list(features)
    parts = []
    for i in range(0, len(features), UNPIVOT_CHUNK):
        chunk = features[i : i + UNPIVOT_CHUNK]
        cols = [F.col(f"`{c}`").cast(cast).alias(c) if cast else F.col(f"`{c}`") for c in chunk]
        narrow = df.select(*[F.col(f"`{c}`") for c in keep], *cols)
        parts.append(narrow.unpivot([F.col(f"`{c}`") for c in keep], [F.col(f"`{c}`") for c in chunk], "feature", "value"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("value", nan_to_null(F.col("value"))) if cast == "double" else out


def explode_features(df: DataFrame, keep: Sequence[str], array_col: str) -> DataFrame:
    """Long form of an array column; the feature is its zero-based position."""
    long = df.select(*keep, F.posexplode(array_col).alias("feature", "value"))
    return long.withColumn("value", nan_to_null(F.col("value").cast("double")))


def array_features(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    """Vector form of an array column."""
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def assemble_features(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Vector form of plain columns; missing cells must be filled first."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)
