"""Structured Streaming jobs for the live feed."""
