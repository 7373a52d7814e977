"""Linear algebra, encodings, graphs, rasters and benchmark analytics."""
