"""Scalar expressions and aggregates."""
