"""Readers and writers for rasters and tiles."""
