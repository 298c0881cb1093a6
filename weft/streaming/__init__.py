"""Bounded streams: the dataflow API over DataFrames. There are no event times, so no watermarks or windows."""
