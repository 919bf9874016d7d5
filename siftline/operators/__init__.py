"""Operators: DataFrame -> DataFrame, no actions inside."""
