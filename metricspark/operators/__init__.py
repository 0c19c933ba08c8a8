"""Operators: each is DataFrame -> DataFrame with column names and thresholds as arguments."""
