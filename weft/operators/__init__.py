"""Operators: the query builder, bounded streams and iteration."""
