"""Structured Streaming forms of the recurring run."""
