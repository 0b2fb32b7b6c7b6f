"""Structured Streaming: ingest and the stateful market operator."""
