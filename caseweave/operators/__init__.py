"""Operators: functions from a log to a DataFrame."""
