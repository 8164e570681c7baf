"""Geospatial tiles, moving objects and their logs as Spark DataFrames."""
