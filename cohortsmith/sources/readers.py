"""Reading cohorts with fixed schemas."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The clinical table.
CLINICAL_SCHEMA = T.StructType(
    [
        T.StructField("x0_Sample_ID", T.StringType()),
        T.StructField("x0_Age", T.StringType()),
        T.StructField("x0_BMI", T.StringType()),
        T.StructField("x0_Sample_Minutes", T.StringType()),
        T.StructField("x0_Cortisol", T.StringType()),
        T.StructField("x0_Sex", T.StringType()),
    ]
)


def load_cohort(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A wide cohort table. Text files come in as strings only, so that one odd cell
    cannot change a column's type; without `columns` the header names them."""
    if str(path).rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    r = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if columns is not None:
        return r.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
    return r.option("inferSchema", False).csv(path)


def load_clinical(spark: SparkSession, path: str) -> DataFrame:
    """The clinical table, a header over the fixed fields as text."""
    if str(path).rstrip("/").endswith(".parquet"):
        return spark.read.schema(CLINICAL_SCHEMA).parquet(path)
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(header, CLINICAL_SCHEMA.names)
    return header.select(*[f"`{name}`" for name in CLINICAL_SCHEMA.names])


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail on missing columns; reads the schema only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
