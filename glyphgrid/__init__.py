"""Raster and symbol-stream analytics expressed with Spark DataFrames."""
