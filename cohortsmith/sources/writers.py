"""Writing results. Existing output is never replaced silently."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A summary or run record as JSON lines."""
    df.write.mode("errorifexists").json(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """One folder per run. The caller names the run, so a retry replaces only its own output."""
    tagged = df.withColumn("run_id", F.lit(run_id))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Errors surface; a model that was not saved must not look saved."""
    model.write().overwrite().save(path)
