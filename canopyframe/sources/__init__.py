"""Scans and sinks: raster files, manifests, sensor logs, calibrations, configuration, result tables."""
