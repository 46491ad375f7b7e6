"""Operators over DataFrames: joins, aggregates, windows, sampling, models and statistics."""
