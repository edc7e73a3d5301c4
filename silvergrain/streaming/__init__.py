"""Streams of file and indexing events."""
