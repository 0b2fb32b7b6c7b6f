"""Readers and writers: wire frames, captures, logs."""
