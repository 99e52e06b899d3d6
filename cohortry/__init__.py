"""Cohort analytics on Spark: operators that take DataFrames and return DataFrames."""

__version__ = "0.1.0"
