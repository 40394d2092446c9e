"""Operators on DataFrames of tiles, extents, rasters and meshes."""
