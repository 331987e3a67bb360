"""Structured Streaming jobs that keep the batch results current."""
