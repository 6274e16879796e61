"""Operators: functions of DataFrames or columns."""
