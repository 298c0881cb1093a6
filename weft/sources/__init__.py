"""Schemas, graphs over tables, readers and sinks."""
