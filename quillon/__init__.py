"""Quillon: measurement-and-decision operators over text items, on Spark DataFrames."""
