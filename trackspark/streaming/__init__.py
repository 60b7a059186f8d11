"""Structured Streaming counterparts of the two incremental operators."""
