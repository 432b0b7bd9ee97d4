"""Structured Streaming operators (stateful run-log processing)."""
