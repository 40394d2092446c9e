"""Tile requests as streams."""
