"""Operators: functions from DataFrames to a DataFrame, lazy, without actions unless their docstring says so."""
