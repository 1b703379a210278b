"""Append-only ledgers as Structured Streaming jobs."""
