"""Readers for files and rules, and append sinks for the tracking tables."""
