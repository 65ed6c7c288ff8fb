"""Imports every catalog module so that its queries are registered."""
from . import columns, feeds, rasters, situations, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
