"""Incremental versions of the jobs on Structured Streaming."""
