"""Terrain analytics on Spark: tiles, rasters, mosaics and meshes as DataFrames."""
