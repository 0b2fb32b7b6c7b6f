"""Whole queries: the feature pipeline, replay, and the driver's queries with their SQL."""
