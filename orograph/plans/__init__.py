"""Whole queries built from the operators, over the star-schema tables."""

from orograph.plans import cache_queries, catalog_queries, mesh_queries, source_queries, tile_queries  # noqa: F401
from orograph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
