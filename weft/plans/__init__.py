"""Patterns, statistics, planners and the lowering of plans to DataFrames."""
