"""Readers and writers; every reader adds explicit order columns."""
