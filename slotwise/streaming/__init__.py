"""Structured Streaming form of the slot jobs."""
