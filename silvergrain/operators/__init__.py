"""Operators of the retrieval engine over DataFrames of points, edges, listings and events."""
