"""Structured Streaming forms of append-and-resume."""
