"""Whole plans: the query catalog and the staged pipeline."""
