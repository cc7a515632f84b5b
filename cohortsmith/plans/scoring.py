"""Saving a fitted model with its recipe, and scoring new rows with both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import positive_probability
from ..sources.readers import load_model
from ..sources.writers import save_model, write_parquet
from .recipes import apply_recipe, recipe_rows


def save_fitted(model, recipe: DataFrame, path: str) -> None:
    """Model and recipe (repeat, fold, feature, rank, fill, mean, sd) under one folder."""
    save_model(PipelineModel(stages=[model]), f"{path}/model")
    write_parquet(recipe.coalesce(1), f"{path}/recipe")


def load_fitted(spark: SparkSession, path: str) -> tuple[PipelineModel, list[dict]]:
    recipes = recipe_rows(spark.read.parquet(f"{path}/recipe"))
    if len(recipes) != 1:
        raise ValueError("a saved model has exactly one recipe")
    return load_model(f"{path}/model"), next(iter(recipes.values()))


def score_new(model, recipe: Sequence[dict], df: DataFrame, keep: Sequence[str], array_col: str | None = None) -> DataFrame:
    """keep..., predicted, probability. New rows are filled and scaled with the training
    numbers of the recipe; nothing is refitted and no state is kept, so a streaming
    DataFrame may come in as well."""
    ready = apply_recipe(df, recipe, keep, array_col)
    scored = model.transform(ready)
    p = positive_probability(scored)
    return scored.select(*keep, (p >= 0.5).cast("int").alias("predicted"), p.alias("probability"))
