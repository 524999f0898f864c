"""Structured Streaming jobs built from the same operators as the batch path."""
