"""Windowed counts and the period pipeline on Structured Streaming."""
