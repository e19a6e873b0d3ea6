"""Relational operators of the audit: DataFrames in, DataFrames out, nothing collected."""
