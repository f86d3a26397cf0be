"""Imports every query module so that all queries are registered."""

from terraloom.catalog import coordinates, evidence, lidar, pixels, plans, rasters, regions, reports, scalars, shapes, sources, spatial  # noqa: F401
from terraloom.catalog.registry import ORACLES, QUERIES  # noqa: F401
