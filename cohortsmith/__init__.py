"""Cohort analytics on Spark: label, clean, profile, split, rebalance, select,
fit, score and report over DataFrames of any height and width."""
