"""Operators: functions from DataFrames to DataFrames, composed with ``DataFrame.transform``."""
