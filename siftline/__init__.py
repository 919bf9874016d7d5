"""Siftline: query-aware extractive compression and its dataset work, on Spark."""
