"""Choosing columns: deny-lists, and filters on one profile pass over the long form."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_on

# Columns that describe the row and never serve as features.
METADATA_COLUMNS = (
    "x0_LC_ID",
    "Long_COVID",
    "x0_Censor_Complete",
    "x0_Censor_Cohort_ID",
    "x0_Patient_Cluster_Label",
    "x0_Patient_Cluster",
    "x0_Censor_Oral_Steroid",
    "x0_Censor_Pit_Adre_Dysfunction",
    "x0_Censor_Pregnancy",
    "x0_Censor_Active_Chemotherapy",
    "x0_Censor_Active_Malignancy",
    "x0_Censor_Autoimmune_Pre_Exist",
    "x0_Censor_Immuno_Supress_Med",
    "x0_Censor_IVIG",
    "x0_Censor_Thyroid",
    "x0_Symp_Survey_Long_COVID_Propensity_Score_Optimized",
    "x0_LC_Symptom_totalsympt",
    "x0_LCSI_ID_Label",
    "x1_Description_Cytokine_Label",
    "x1_ELISA_Label",
    "x1_SI_ID_Label",
)
# Fixed value: marks survey answers that leak the label.
LEAKAGE_SUBSTRING = "x0_Symp_Survey_"


def drop_columns(df: DataFrame, names: Iterable[str] = METADATA_COLUMNS) -> DataFrame:
    """Drop the named columns; absent ones are ignored."""
    return df.drop(*names)


def drop_by_substring(df: DataFrame, text: str = LEAKAGE_SUBSTRING) -> DataFrame:
    return df.drop(*[c for c in df.columns if text in c])


def drop_features_by_substring(long: DataFrame, text: str = LEAKAGE_SUBSTRING) -> DataFrame:
    """The same on the long form: a row filter that reaches the scan."""
    return long.filter(~F.col("feature").contains(text))


def profile_features(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One pass with map-side partial aggregates; every filter below reads this table.

    min < max says 'two or more distinct values' without a distinct shuffle.
    """
    v = F.col("value")
    return long.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(v).alias("n_valid"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("variance"),
    )


def _varies() -> Column:
    return F.coalesce(F.col("min_value") < F.col("max_value"), F.lit(False))


def numeric_rate(profile: DataFrame, threshold: float = 0.5) -> DataFrame:
    rate = F.col("n_valid") / F.col("n")
    return profile.select("feature", rate.alias("rate"), (rate > threshold).alias("kept"))


def not_all_null(profile: DataFrame) -> DataFrame:
    return profile.select("feature", "n_valid", (F.col("n_valid") > 0).alias("kept"))


def not_constant(profile: DataFrame) -> DataFrame:
    """Two or more values where null counts as a value, all-null columns excluded."""
    has_null = F.col("n_valid") < F.col("n")
    return profile.select("feature", (_varies() | ((F.col("n_valid") > 0) & has_null)).alias("kept"))


def not_zero_variance(profile: DataFrame) -> DataFrame:
    """Two or more distinct non-null values."""
    return profile.select("feature", _varies().alias("kept"))


def variance_above(profile: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Population variance over the valid cells."""
    v = F.coalesce(F.col("variance"), F.lit(0.0))
    return profile.select("feature", v.alias("variance"), (v > threshold).alias("kept"))


def filter_report(decisions: dict[str, DataFrame]) -> DataFrame:
    """Features in and out per filter."""
    out = None
    for name, d in decisions.items():
        row = d.agg(
            F.count(F.lit(1)).alias("features_in"),
            F.count(F.when(F.col("kept"), 1)).alias("features_out"),
        ).select(F.lit(name).alias("filter"), "features_in", "features_out")
        out = row if out is None else out.unionByName(row)
    return out


def keep_features(long: DataFrame, decision: DataFrame) -> DataFrame:
    """Only the rows of kept features."""
    return join_on(long, decision.filter("kept").select("feature"), ["feature"], "left_semi")


def select_columns(df: DataFrame, keep: Sequence[str], names: DataFrame) -> DataFrame:
    """Wide form of a selection: the names are schema, so they come to the driver."""
    chosen = {r[0] for r in names.select("feature").collect()}
    return df.select(*keep, *[F.col(f"`{c}`") for c in df.columns if c in chosen and c not in keep])
