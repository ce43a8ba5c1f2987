"""Structured Streaming forms of the run-log and series operators."""
