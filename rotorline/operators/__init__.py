"""Batch operators: functions from DataFrames to DataFrames, composable with `transform`."""
