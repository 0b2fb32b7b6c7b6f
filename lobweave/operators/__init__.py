"""Operators over market events as DataFrames."""
