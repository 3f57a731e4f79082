"""Variance and driver attribution on Spark DataFrames."""

__version__ = "0.1.0"
