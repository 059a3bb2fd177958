"""Operators: functions from DataFrames to DataFrames, lazy wherever Spark allows."""
