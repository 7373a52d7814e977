"""Sparse arrays, graphs and rasters as relations on Spark."""
