"""Registered queries of the engine and their SQL."""

from . import assembly, basics, calibrations, catalogs, detection, generated, measures, rasters, records, services, series, shapes, tracks, vectors
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "assembly", "basics", "calibrations", "catalogs", "detection", "generated", "measures", "rasters", "records", "series", "services", "shapes", "tracks", "vectors"]
