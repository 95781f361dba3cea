"""Importing this module registers every query."""

from terralane.plans import areas, joins, layers, layers_io, networks, rasters, shapes, statistics, terrains, texts  # noqa: F401
from terralane.plans.registry import ORACLES, QUERIES  # noqa: F401
