"""All queries of the library and their SQL equivalents."""

from __future__ import annotations

from . import kernel_queries, raster_queries, series_queries

QUERIES = raster_queries.QUERIES | series_queries.QUERIES | kernel_queries.QUERIES
ORACLES = raster_queries.ORACLES | series_queries.ORACLES | kernel_queries.ORACLES
