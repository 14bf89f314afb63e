"""Operators on DataFrames: rules, roll-ups, metrics, sampling, merges."""
