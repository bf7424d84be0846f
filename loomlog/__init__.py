"""Sequence, alignment and blend analytics for keyed logs, on Spark DataFrames."""
