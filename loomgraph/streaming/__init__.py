"""Structured Streaming: event log and incremental state."""
