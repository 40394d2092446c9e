"""Column functions: tiling, geometry, parameters, names."""
