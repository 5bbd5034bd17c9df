"""Operators: DataFrame to DataFrame, lazy, with explicit keys."""
