"""Structured Streaming over the feedback log; every stream has a batch query that gives the same rows."""
